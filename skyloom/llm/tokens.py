"""Token ids of a whole corpus by a public byte-level BPE."""

from __future__ import annotations

import json
import os
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZER_DIR = os.environ.get("SKYLOOM_TOKENIZERS", "/opt/tokenizers")
#: Longer texts are halved until each part is at most this long.
LEAF_CHARS = 4096
_BATCH_CHARS = 200_000
#: The longest contraction of the word pattern, in characters.
_LOOKAHEAD = 3


#: A tokenizer's file is sent to the executors up to this size; a larger one they must find at its path.
MAX_SHIPPED_BYTES = 64 << 20


def _shipped(spark: SparkSession, path: str) -> Callable[[], str]:
    """A function that gives the tokenizer on an executor: the file's text, sent once to each, or its path."""
    if os.path.getsize(path) > MAX_SHIPPED_BYTES:
        return lambda: path
    with open(path, encoding="utf-8") as file:
        text = spark.sparkContext.broadcast(file.read())
    return lambda: text.value


@lru_cache(maxsize=4)
def _tokenizer(source: str):
    """The tokenizer of a path or of the text of its file."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task a core already
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(source) if source.lstrip().startswith("{") else Tokenizer.from_file(source)
    tokenizer.encode_special_tokens = True
    return tokenizer


#: The word pattern of byte-level BPE tokenizers (fixed value).
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def _quick(source: str):
    """A faster encoder with the same ids, or None.

    There is one where the file is a plain byte-level BPE: the usual word pattern, no normalizer, no
    blank put in front, and merges numbered in order, so that a token's id is also its rank.
    """
    try:
        import tiktoken
    except ImportError:
        return None
    text = source
    if not source.lstrip().startswith("{"):
        with open(source, encoding="utf-8") as file:
            text = file.read()
    spec = json.loads(text)
    model, words = spec.get("model", {}), spec.get("pre_tokenizer") or {}
    plain = model.get("type", "BPE") == "BPE" and words.get("type") == "ByteLevel" and words.get("use_regex", True) and not words.get("add_prefix_space", True)
    odd = spec.get("normalizer"), model.get("dropout"), model.get("byte_fallback"), model.get("ignore_merges"), model.get("continuing_subword_prefix"), model.get("end_of_word_suffix")
    vocabulary, merges = model.get("vocab", {}), [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
    if not plain or any(odd) or any(vocabulary.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
        return None
    table = _token_bytes(source)[: 256 + len(merges)]
    return tiktoken.Encoding("plain", pat_str=_WORDS, mergeable_ranks={token: i for i, token in enumerate(table)}, special_tokens={})


@dataclass
class Encoded:
    """A text's tokens and where its words (the tokenizer's pre-tokens) start.

    BPE never merges across words, so tokens follow from words alone.
    """

    text: str
    ids: list[int]
    chars: list[int]  # the place of each word's first character
    tokens: list[int]  # the number of each word's first token


def _leaf(text: str, encoding) -> Encoded:
    chars, tokens, seen = [], [], None
    for number, (word, (start, _)) in enumerate(zip(encoding.word_ids, encoding.offsets, strict=True)):
        if word != seen:
            chars.append(start)
            tokens.append(number)
            seen = word
    return Encoded(text, encoding.ids, chars, tokens)


def join(left: Encoded, right: Encoded, encode) -> Encoded:
    """The encoding of ``left.text + right.text``.

    A word stands if it ends before its part does and starts at least ``_LOOKAHEAD`` characters
    before that end: the pattern that finds words looks no farther than one character behind a
    run, and at most that many characters from the start for a contraction such as 're. All words
    of the left part up to the first that might change are kept; the rest is encoded anew together
    with a window of the right part. The window has met the right part as soon as one of its
    boundaries behind a standing word is one of the right part too: words are found from left to
    right without looking back, so from there on the right part's words stand. Until then the
    window doubles; at worst it holds the whole right part.
    """
    if not left.ids:
        return right
    if not right.ids:
        return left
    first = min(len(left.chars) - 1, bisect_right(left.chars, len(left.text) - _LOOKAHEAD))
    cut, kept = left.chars[first], left.tokens[first]
    overlap = len(left.text) - cut
    text = left.text + right.text
    words = 2
    while True:
        whole = words >= len(right.chars)
        reach = len(right.text) if whole else right.chars[words]
        window = encode(text[cut : len(left.text) + reach])
        for number in range(1, len(window.chars)):
            place = window.chars[number] - overlap
            if not whole and window.chars[number - 1] > len(window.text) - _LOOKAHEAD:
                break
            if place < 0:
                continue
            at = bisect_left(right.chars, place)
            if at < len(right.chars) and right.chars[at] == place:
                shift = kept + window.tokens[number] - right.tokens[at]
                return Encoded(
                    text,
                    left.ids[:kept] + window.ids[: window.tokens[number]] + right.ids[right.tokens[at] :],
                    left.chars[:first] + [c + cut for c in window.chars[:number]] + [c + len(left.text) for c in right.chars[at:]],
                    left.tokens[:first] + [t + kept for t in window.tokens[:number]] + [t + shift for t in right.tokens[at:]],
                )
        if whole:
            return Encoded(
                text, left.ids[:kept] + window.ids, left.chars[:first] + [c + cut for c in window.chars], left.tokens[:first] + [t + kept for t in window.tokens]
            )
        words *= 2


def _halves(text: str, leaf_chars: int) -> list[str]:
    if len(text) <= leaf_chars:
        return [text]
    middle = len(text) // 2
    return _halves(text[:middle], leaf_chars) + _halves(text[middle:], leaf_chars)


def _encodings(texts: list[str | None], path: str, leaf_chars: int) -> Iterator[tuple[int, Encoded | object]]:
    """The place and the encoding (with ids) of each text that isn't null or empty.

    Texts of one leaf are encoded in one call. The leaves of a longer one are joined pairwise, level by level.
    """
    tokenizer = _tokenizer(path)
    encode = lambda text: _leaf(text, tokenizer.encode(text, add_special_tokens=False))
    short = [i for i, t in enumerate(texts) if t and len(t) <= leaf_chars]
    if quick := _quick(path):
        yield from ((i, Encoded(texts[i], quick.encode_ordinary(texts[i]), [], [])) for i in short)
    else:
        yield from zip(short, tokenizer.encode_batch_fast([texts[i] for i in short], add_special_tokens=False), strict=True)
    for i, text in enumerate(texts):
        if not text or len(text) <= leaf_chars:
            continue
        leaves = _halves(text, leaf_chars)
        level = [_leaf(t, e) for t, e in zip(leaves, tokenizer.encode_batch(leaves, add_special_tokens=False), strict=True)]
        while len(level) > 1:
            level = [join(*level[k : k + 2], encode) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
        yield i, level[0]


def encode_texts(texts: list[str | None], path: str, leaf_chars: int = LEAF_CHARS) -> list[list[int]]:
    """The ids of each text; none for null and empty texts."""
    out: list[list[int]] = [[] for _ in texts]
    for i, encoding in _encodings(texts, path, leaf_chars):
        out[i] = encoding.ids
    return out


def count_texts(texts: list[str | None], path: str, leaf_chars: int = LEAF_CHARS) -> list[int]:
    """The number of ids of each text, without making lists of them where the tokenizer can tell it."""
    out = [0] * len(texts)
    for i, encoding in _encodings(texts, path, leaf_chars):
        out[i] = len(encoding.ids) if isinstance(encoding, Encoded) else len(encoding)
    return out


@lru_cache(maxsize=4)
def _token_bytes(path: str) -> list[bytes]:
    """The bytes of every id. Byte-level vocabularies write a printable byte as its own character and
    the others, in order, as characters from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(others)}
    tokenizer = _tokenizer(path)
    return [
        bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        for token in (tokenizer.id_to_token(i) for i in range(tokenizer.get_vocab_size()))
    ]


def decode_ids(ids: list[int], path: str) -> str:
    """The text of ``ids``: the bytes of the two halves end to end, and so up the tree."""
    table = _token_bytes(path)

    def part(low: int, high: int) -> bytes:
        if high - low <= LEAF_CHARS:
            return b"".join(table[i] for i in ids[low:high])
        middle = (low + high) // 2
        return part(low, middle) + part(middle, high)

    return part(0, len(ids)).decode("utf-8", "replace")


def _batches(batch: pa.RecordBatch) -> Iterator[tuple[list, list]]:
    keys, texts, held = [], [], 0
    for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        keys.append(key)
        texts.append(text)
        held += len(text or "")
        if held >= _BATCH_CHARS:
            yield keys, texts
            keys, texts, held = [], [], 0
    if keys:
        yield keys, texts


def tokenizer_path(name: str = "byte_bpe_50k.json", folder: str = TOKENIZER_DIR) -> str:
    return f"{folder}/{name}"


def encode_corpus(documents: DataFrame, key: str, text: str, path: str | None = None, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """Columns ``key`` and ids (array of int): the ids of each text without special tokens.

    A text longer than ``leaf_chars`` is halved recursively, its parts are encoded, and neighbours
    are joined by re-encoding a growing window at their seam (see ``join``); the result is that of
    encoding the whole text at once. Null and empty texts have no ids; blank ones have those of
    their blanks. Strings of special tokens in a text are ordinary text. Rows aren't shuffled, and
    repeated rows stay. Extra columns are dropped. An empty table gives an empty one.

    ``path`` is the tokenizer's file on the driver; the executors get its text (see ``_shipped``).
    """
    source = _shipped(documents.sparkSession, path or tokenizer_path())
    kind = documents.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, texts in _batches(batch):
                ids = encode_texts(texts, source(), leaf_chars)
                yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    return documents.select(key, text).mapInArrow(run, schema)


def count_tokens(documents: DataFrame, keys: list[str], text: str, path: str | None = None) -> DataFrame:
    """``keys`` and n_tokens (bigint) of each row; 0 for null and empty texts."""
    source = _shipped(documents.sparkSession, path or tokenizer_path())
    schema = T.StructType([documents.schema[k] for k in keys] + [T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keys))
            numbers = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows), pa.int64()), texts], names=["n", "text"])
            counts = [n for _, part in _batches(numbers) for n in count_texts(part, source())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(counts, pa.int64())], names=[*keys, "n_tokens"])

    return documents.select(*keys, F.col(text)).mapInArrow(run, schema)
