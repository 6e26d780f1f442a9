"""Broken prompt and response pairs."""

from __future__ import annotations

import json
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Defects in the order in which the first that applies counts.
DEFECTS = ("refusal", "copied", "other_language", "empty", "truncated")

# ---- Fixed values: phrases -------------------------------------------------------------------
#: A speaker is unable or unwilling. Sound reasoning says so too ("I cannot join 5 and 9"), so
#: these count only in texts that do no work.
_UNABLE = re.compile(
    "|".join(
        (
            r"(?:我们?|本人|本助手|本模型)(?:实在|暂时|恐怕|确实|真的|目前|也|只能说|并)?(?:无法|不能|没有办法|没办法|不便|不方便|不可以|没有权限|无权|选择不|不会为|不愿|不想|不打算|拒绝|没能力|不具备)",
            r"(?:数据|任务|请求|问题|内容)我(?:不予|不|无法)|我不予",
            r"\b(?:i|we)(?: am|'m| are|'re) (?:not able|unable|not allowed|not permitted|not in a position|not (?:\w+ )?(?:comfortable|willing))\b|\bnot (?:one|something) i(?: am|'m) (?:comfortable|willing)",
            r"\b(?:i|we) (?:really |simply |just )?(?:can(?:no|')t|can not|could not|couldn't|won't|will not|do not|don't|would not|wouldn't|shouldn't|should not|would rather not|prefer not)\b",
            r"\b(?:something|nothing|choosing \w+) (?:is )?(?:something )?i do not do\b|is something i (?:do not|don't|cannot|can't|won't) do",
            r"\b(?:i|we) (?:must|have to|need to|will|am going to|are going to|choose to) (?:respectfully |politely )?(?:pass\b|abstain|not )",
            r"\bich (?:kann|darf|werde|möchte) \w*(?:\s\w+){0,4}? (?:nicht|keine\w*)\b",
            r"\bje (?:ne (?:peux|puis|vais|souhaite)|n'ai pas le droit)",
            r"\b(?:no puedo|no podré|no voy a|no me es posible|no estoy en condiciones|non posso|non sono in grado|não posso|não consigo|não vou)\b",
            r"я не (?:могу|смогу|буду|вправе|имею права)",
            r"でき(?:ません|かね)|いたしかね|(?:할|드릴) 수 없|도와드릴 수",
        )
    )
)
#: Refusals in so many words: declining, the speaker's rules or nature, no help, no result.
_DECLINES = re.compile(
    "|".join(
        (
            r"恕(?:我)?(?:不能|无法|难|不)|超出了?(?:我|本人|我们|模型)的?(?:能力|权限|职责|知识|服务)|我?帮不上忙|爱莫能助|无可奉告|选择不(?:回答|参与)",
            r"(?:无法|不能)(?:为您|向您|给您|协助|提供(?:帮助|协助)|回答(?:这|该|您|你)|满足(?:这|该|您|你))|拒绝(?:回答|提供|协助|完成)(?:这|该|此|您|你)",
            r"作为(?:一个|一款|一名)?(?:大?语言模型|人工智能|AI)|(?:与|违反|不符合?)我?的?使用(?:准则|政策|规范)",
            r"\b(?:decline|refuse) to\b|\b(?:i|we) (?:must|have to|need to|will) (?:respectfully |politely )?(?:decline|refuse)\b",
            r"\bno (?:result|answer|partition|grouping|solution|response) (?:will|can) be (?:given|provided|offered)|not be appropriate for me",
            r"(?:falls?|lies?|is|goes) (?:outside|beyond) (?:of )?(?:what (?:i|we) |my |our |the scope of (?:my|what (?:i|we)))",
            r"against my (?:guidelines|policy|policies|rules|principles)|\bas an? (?:ai |large )?(?:language model|ai\b|assistant)",
            r"\b(?:i|we) (?:can(?:no|')t|can not|won't|will not|am unable to|am not able to) (?:be able to )?(?:help|assist|answer|comply|fulfil|respond|engage|take part|discuss)\b",
            r"ablehnen|dabei nicht (?:helfen|unterstützen)|décliner|refuse de|отказать|como (?:un )?modelo de lenguaje|come modello linguistico|in quanto modello|rifiuto di|me niego|debo declinar|recuso",
            r"お(?:手伝い|答え|応え)(?:は)?(?:でき|いたし)(?:ません|かね)|対応(?:は)?(?:でき|いたし)(?:ません|かね)|언어 모델|거절",
        )
    )
)
_APOLOGY = re.compile(
    r"抱歉|对不起|不好意思|请原谅|很遗憾|遗憾的是|\bsorry\b|\bafraid\b|apolog|unfortunately|regrettably|leider|désolé|malheureusement|regrette"
    r"|lo siento|lamento|lamentablemente|mi dispiace|purtroppo|desculpe|infelizmente|извините|к сожалению|申し訳|すみません|죄송"
)
#: Texts that stand for nothing, without punctuation.
_NOTHING = frozenset(
    ("null", "none", "nil", "na", "nan", "undefined", "empty", "blank", "tbd", "todo", "placeholder", "no answer", "no output",
     "nothing", "无", "空", "暂无", "没有", "待补充", "待填写", "略", "无内容", "空白", "无结果", "无输出", "пусто", "leer", "vide", "なし")
)
#: Closings without a full stop.
_CLOSINGS = re.compile(
    r"(?:完成|结束|完毕|通过|成立|无误|如上|为止|就这样)$|^以上|\b(?:settles (?:it|the \w+)|is (?:complete|done|finished)|all done|that is all|end of \w+)$"
)
_LABELS = re.compile(r"^\s*(?:问题|题目|任务是?|指令|输入|question|the task|task|instruction|prompt|input|q)\s*[:：]\s*", re.I)
_WORDS = {
    "en": frozenset("the and of to is it so that with for from be can this there not no are has which by in on at as its an all every".split()),
    "de": frozenset("der die das und ist mit von zu den dem ein eine nicht sich ich auf für im wird zum zur alle daher beide sind es damit nur".split()),
    "fr": frozenset("le la les des du et est un une pour que qui dans ne pas plus nous je par sur avec au cette ce donc on ainsi n'est depuis elle l'ordre".split()),
    "es": frozenset("el los las del y es una para que por con no se su al como está son".split()),
    "it": frozenset("il lo gli della di che è non per una con sono del alla dei nel questo più come si ed".split()),
    "pt": frozenset("o os as da do que não para uma com em por mais como é são dos ao na no se".split()),
    "nl": frozenset("de het een en van niet dat is op te voor met zijn aan die er maar ook".split()),
}
# ----------------------------------------------------------------------------------------------

_THINK = re.compile(r"</?think>", re.I)
_INVISIBLE = re.compile("[\u200b\u200c\u200d\u2060\ufeff\u00ad]+")
_NO_LETTER = re.compile(r"[\W_]+")
_WORD = re.compile(r"[^\W_]+")
#: Every branch of _UNABLE and _DECLINES holds one of these, in texts folded to lower case; looking for them first is quick.
_TRIGGERS = (
    "我", "本人", "本助手", "本模型", "i can", "i could", "i will", "i won't", "i am", "i'm", "i do", "i would", "i should", "i really", "i simply", "i just", "i prefer", "i must", "i have", "i need", "i choose",
    "we can", "we could", "we will", "we won't", "we are", "we're", "we do", "we would", "we should", "we really", "we simply", "we just", "we prefer", "we must", "we have", "we need", "we choose",
    "ich ", "je n", "no p", "no v", "no me", "no est", "non ", "não ", "я не", "でき", "かね", "수 ",
    "恕", "超出", "帮不上", "爱莫能助", "无可奉告", "选择不", "无法", "不能", "拒绝", "作为", "使用", "declin", "refus", "no result", "no answer", "no partition", "no grouping", "no solution", "no response",
    "appropriate", "outside", "beyond", "against my", "language model", "as a", "ablehnen", "dabei nicht", "отказать", "modelo", "modello", "rifiuto", "niego", "recuso", "手伝い", "お答え", "お応え", "対応", "언어", "거절",
)
_IDENTIFIER = re.compile(r"[A-Za-z]+_\w+|\b(?:Satellite|Sensor|Target)\d*\b|\b[mwq]\b|\bJSON\b|https?://\S+|\{[^{}]*\}", re.I)
_WINDOW = 12


@lru_cache(maxsize=8)
def _bare(text: str | None) -> str:
    """The text without marks of thought, invisible characters and outer space."""
    return _INVISIBLE.sub("", _THINK.sub("", text or "")).strip()


def _letters(text: str) -> str:
    """Only letters and digits, folded; copies that differ in space, case or punctuation become equal."""
    return _NO_LETTER.sub("", unicodedata.normalize("NFKC", text).lower())


def is_empty(text: str | None) -> bool:
    """Nothing but blanks, punctuation or a word for nothing."""
    bare = unicodedata.normalize("NFKC", _bare(text)).lower().replace("/", "")
    words = [m[0] for m in islice(_WORD.finditer(bare), 3)]  # no word for nothing has three words
    return not words or " ".join(words) in _NOTHING


_CLAUSES = re.compile(r"[。！？!?;；\n]|\.\s")
_NUMBERS = re.compile(r"\d+")


def is_refusal(text: str | None, least_work: int = 3) -> bool:
    """Whether the text declines its task.

    Judged by sentences. Work is a sentence with numbers, since any sound answer names satellites
    and targets. A sentence that refuses in so many words, or that is unable and apologises,
    makes a refusal where fewer than ``least_work`` other sentences do work; a sentence that is
    merely unable does where it and all but one of the others name no numbers.
    """
    folded = unicodedata.normalize("NFKC", _bare(text)).lower().replace("’", "'")
    if not any(t in folded for t in _TRIGGERS) or not (_UNABLE.search(folded) or _DECLINES.search(folded)):
        return False
    sentences = [s for s in _CLAUSES.split(folded) if s.strip()]
    numbers = [len(_NUMBERS.findall(s)) for s in sentences]
    work = sum(n > 0 for n in numbers)
    for sentence, own in zip(sentences, numbers, strict=True):
        unable, sorry = _UNABLE.search(sentence), _APOLOGY.search(sentence)
        others = work - (own > 0)
        if (_DECLINES.search(sentence) and own < 2 or unable and sorry) and others < least_work:
            return True
        if unable and not own and others < 2:
            return True
    return False


def is_copied(text: str | None, sources: tuple[str | None, ...], least: float = 0.9) -> bool:
    """Whether at least ``least`` of the text's letters, in windows of 12, stand in the sources too.

    A label such as "Question:" before the copy doesn't count. Sound reasoning that quotes its
    input has work of its own beside the quotation and stays below.
    """
    own = _letters(_LABELS.sub("", _bare(text)))
    if not own:
        return False
    given = "\0".join(_letters(s) for s in sources if s)
    if own in given:
        return len(own) >= _WINDOW
    if len(own) < 2 * _WINDOW:
        return False
    windows = [own[i : i + _WINDOW] for i in range(0, len(own) - _WINDOW + 1, _WINDOW)]
    # Every window of the sources goes into a set once, so that the test is linear in both texts.
    known = {given[i : i + _WINDOW] for i in range(len(given) - _WINDOW + 1)}
    # The sources' own seams break a few windows, so each joint of instruction and input is forgiven once.
    found = sum(w in known for w in windows)
    return found + 1 >= least * len(windows) and found >= 2 and found / len(windows) >= least - 0.2


_LANGUAGES_OF: dict[str, list[str]] = defaultdict(list)
for _name, _known in _WORDS.items():
    for _word in _known:
        _LANGUAGES_OF[_word].append(_name)
_SCRIPTS = {"han": re.compile("[一-鿿]+"), "kana": re.compile("[぀-ヿ]+"), "hangul": re.compile("[가-힣]+"), "cyrillic": re.compile("[Ѐ-ӿ]+")}
_LATIN_WORD = re.compile(r"[A-Za-zÀ-ÿ][A-Za-zÀ-ÿ'’]+")


@lru_cache(maxsize=1024)
def language(text: str | None) -> str | None:
    """zh, ja, ko, ru, en, de, fr, es, it, pt or nl, or None where too little of the text tells."""
    plain = _IDENTIFIER.sub(" ", _bare(text))
    han, kana, hangul, cyrillic = (sum(map(len, script.findall(plain))) for script in _SCRIPTS.values())
    words = _LATIN_WORD.findall(plain)
    scripts = {
        "zh": han if kana * 10 <= han else 0,
        "ja": han + kana if kana * 10 > han else 0,
        "ko": hangul,
        "ru": cyrillic / 5,
        "latin": len(words) * 1.5,
    }
    best = max(scripts, key=scripts.get)
    if scripts[best] < 5:
        return None
    if best != "latin":
        return best
    votes = dict.fromkeys(_WORDS, 0)
    for word in words:
        for name in _LANGUAGES_OF.get(word.lower().replace("’", "'"), ()):
            votes[name] += 1
    top = max(votes, key=votes.get)
    return top if votes[top] >= 2 else None


def _json(text: str) -> tuple[object, bool]:
    """The value, and whether the text is JSON."""
    try:
        return json.loads(text), True
    except ValueError:
        return None, False


def has_cluster(value: object) -> bool:
    """Whether a result holds at least one cluster: an object with members or a master."""
    if isinstance(value, dict):
        inner = value.get("clusters")
        if inner is not None:
            return has_cluster(inner)
        return any(value.get(k) not in (None, [], "") for k in ("cluster_id", "master", "sats", "targets", "members", "satellites"))
    return isinstance(value, list) and any(has_cluster(v) for v in value if isinstance(v, dict))


_PAIRS = {")": "(", "）": "（", "]": "[", "}": "{", "】": "【", "》": "《", "」": "「"}


def unclosed(text: str) -> bool:
    """Whether a bracket is still open, or a string of JSON, at the end."""
    open_brackets: list[str] = []
    for c in text:
        if c in "([{（【《「":
            open_brackets.append(c)
        elif c in _PAIRS and open_brackets and open_brackets[-1] == _PAIRS[c]:
            open_brackets.pop()
    return bool(open_brackets)


def breaks_off(text: str | None) -> bool:
    """Whether a text of sentences ends before its end: an open bracket, or a last sentence that
    neither ends like one nor is a usual closing."""
    bare = _bare(text)
    if not bare:
        return False
    if unclosed(bare):
        return True
    last = bare[-1]
    if last == "." and re.search(r"(?:^|[^\d.])[01]\.$", bare):
        return True  # a number that breaks off at its decimal point
    if last in ".。!！?？…)）\"”’」』]}】":
        return False
    tail = re.split(r"[。！？!?\n]|\.\s", bare)[-1].strip()
    return _CLOSINGS.search(tail) is None


def find_defects(instruction: str | None, given: str | None, reasoning: str | None, result: str | None) -> list[str]:
    """Every defect of a pair, in the order of ``DEFECTS``."""
    found = set()
    if is_refusal(reasoning):
        found.add("refusal")
    if is_copied(reasoning, (instruction, given)):
        found.add("copied")
    asked, answered = language(instruction), language(reasoning)
    if asked and answered and asked != answered:
        found.add("other_language")
    value, sound = _json(_bare(result))
    if is_empty(reasoning) or is_empty(result):
        found.add("empty")
    elif sound:
        if not has_cluster(value):
            found.add("empty")
    elif "{" not in (result or "") and "[" not in (result or ""):
        found.add("empty")  # words in place of a result
    if breaks_off(reasoning) or (not sound and re.match(r"[\[{]", _bare(result))):
        found.add("truncated")
    return [d for d in DEFECTS if d in found]


_SCHEMA = T.StructType([T.StructField("record_id", T.LongType()), T.StructField("defects", T.ArrayType(T.StringType()))])
_ARROW = pa.schema([("record_id", pa.int64()), ("defects", pa.list_(pa.string()))])


def _flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, *texts = (column.to_pylist() for column in batch.columns)
        defects = [find_defects(*row) for row in zip(*texts, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(defects, pa.list_(pa.string()))], schema=_ARROW)


def flag_pairs(records: DataFrame, key: str, instruction: str, given: str, reasoning: str, result: str) -> DataFrame:
    """record_id and defects, every defect that the pair triggers; sound pairs have an empty array.

    The rules run over whole texts. A null or blank reasoning or result is ``empty``; a null
    instruction or input can be neither copied nor differ in language. Rows equal in all columns
    used come once; extra columns are dropped. An empty table gives an empty one.
    """
    used = [F.col(f"`{c}`") for c in (key, instruction, given, reasoning, result)]
    rows = records.select(used[0].cast("long").alias("record_id"), *(c.alias(f"t{i}") for i, c in enumerate(used[1:])))
    return rows.distinct().mapInArrow(_flag, _SCHEMA)
