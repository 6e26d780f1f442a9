"""Texts, keys and chat records as column expressions. A null text gives null unless stated otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One group of satellites and its targets, as a model writes it.
CLUSTERS = "array<struct<cluster_id: int, master: int, sats: array<int>, targets: array<int>>>"
_MESSAGE = "struct<role: string, content: string>"
# Reasoning in a tag, then the body of the last array; the text ends with its bracket.
_ANSWER = r"(?s)<think>(.*?)</think>(.*?)\[(.*)\]$"


def pair_key(a: Column, b: Column) -> Column:
    """``A-B``."""
    return F.concat(a, F.lit("-"), b)


def split_pair(key: Column) -> Column:
    """A struct of a and b from ``A-B``; null unless there are exactly two parts."""
    parts = F.split(key, "-")
    return F.when(F.size(parts) == 2, F.struct(F.get(parts, F.lit(0)).alias("a"), F.get(parts, F.lit(1)).alias("b")))


def id_number(name: Column, prefix: str) -> Column:
    """The number in a name such as Satellite111; null where something else is left without the prefix."""
    return F.regexp_replace(name, f"^{prefix}", "").try_cast("int")


def one_line(text: Column) -> Column:
    """Runs of white space of any script become one blank, none at either end."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def tagged(text: Column, tag: str) -> Column:
    """What stands in all ``<tag>…</tag>`` blocks, in order, joined by line ends; empty without one."""
    return F.array_join(F.regexp_extract_all(text, F.lit(f"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1)), "\n")


def untagged(text: Column, tag: str) -> Column:
    """The text without its ``<tag>…</tag>`` blocks."""
    return F.regexp_replace(text, f"(?s)<{tag}>.*?</{tag}>", "")


def delimited(text: Column, starts: dict[str, tuple[str, str]]) -> dict[str, Column]:
    """Each named field's text between its two delimiters, trimmed; empty where a delimiter is missing."""
    quote = lambda s: "\\Q" + s + "\\E"
    return {name: F.trim(F.regexp_extract(text, f"(?s){quote(a)}(.*?){quote(b) if b else '$'}", 1)) for name, (a, b) in starts.items()}


def with_summary(reasoning: Column, summary: Column) -> Column:
    """Reasoning, a blank line and the summary; the summary alone where there is no reasoning."""
    return F.when(F.length(reasoning) > 0, F.concat(reasoning, F.lit("\n\n"), F.coalesce(summary, F.lit("")))).otherwise(summary)


def think_json(reasoning: Column, value: Column) -> Column:
    """The reasoning in a think tag, then the value as compact JSON."""
    return F.concat(F.lit("<think>"), reasoning, F.lit("</think>"), F.to_json(value))


def answer_parts(content: Column) -> tuple[Column, Column]:
    """The reasoning and the body of the array of an answer, without backslashes; empty where the form isn't met."""
    return F.regexp_extract(content, _ANSWER, 1), F.translate(F.regexp_extract(content, _ANSWER, 3), "\\", "")


def answer_clusters(content: Column) -> Column:
    """The clusters of an answer; null where it has none or they don't parse."""
    body = answer_parts(content)[1]
    return F.when(content.rlike(_ANSWER), F.from_json(F.concat(F.lit("["), body, F.lit("]")), CLUSTERS))


def fenced_json(text: Column) -> Column:
    """The JSON text of an output: what stands in a json fence, else the whole text, else from its first brace to its last."""
    fence = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    whole = F.trim(text)
    return F.when(F.length(fence) > 0, F.trim(fence)).when(whole.rlike(r"^[\[{]"), whole).otherwise(F.regexp_extract(text, r"(?s)(\{.*\})", 1))


def parsed_output(text: Column, reasoning: str = "chain_of_thought") -> Column:
    """A struct of the reasoning and clusters of an output object, fenced or not; null where it isn't JSON or holds
    other members than these two, or lacks one."""
    body = fenced_json(text)
    keys = F.array_sort(F.json_object_keys(body))
    sound = F.try_parse_json(body).isNotNull() & (keys == F.array_sort(F.array(F.lit(reasoning), F.lit("clusters"))))
    read = F.from_json(body, f"struct<{reasoning}: string, clusters: {CLUSTERS}>")
    return F.when(sound & read["clusters"].isNotNull(), read)


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content")).cast(_MESSAGE)


def chat_record(system: Column, user: Column, assistant: Column) -> Column:
    """Three messages."""
    return F.array(message("system", system), message("user", user), message("assistant", assistant))


def alpaca_to_chat(instruction: Column, given: Column, output: Column) -> Column:
    """An instruction record as a chat: instruction → system, input (empty where null) → user, output → assistant."""
    return chat_record(instruction, F.coalesce(given, F.lit("")), output)


def content_of(messages: Column, role: str) -> Column:
    """The content of the first message of a role; null without one."""
    return F.get(F.filter(messages, lambda m: m["role"] == role), F.lit(0))["content"]


def display_width(text: Column) -> Column:
    """Columns on a terminal: two for an ideograph, one for others."""
    return (F.length(text) + F.regexp_count(text, F.lit("[一-鿿]"))).cast("long")


def file_tag(path: Column, first: int, last: int) -> Column:
    """The part of a file name between two places counted from its end, as in name[-10:-5]."""
    return F.substring(path, F.greatest(F.length(path) + first, F.lit(0)) + 1, F.lit(last - first))


def fill_template(template: str, fields: dict[str, Column]) -> Column:
    """The template with each ``{name}`` replaced by its column; an unknown name is an error, a null field empty."""
    import string

    parts: list[Column] = []
    for text, name, _, _ in string.Formatter().parse(template):
        parts.append(F.lit(text))
        if name is not None:
            if name not in fields:
                raise KeyError(f"the template asks for {name!r}; there are {', '.join(fields)}")
            parts.append(F.coalesce(fields[name].cast("string"), F.lit("")))
    return F.concat(*parts)


class TemplateRegistry:
    """Prompt templates by version."""

    def __init__(self) -> None:
        self._versions: dict[str, tuple[str, str]] = {}

    def add(self, version: str, template: str, about: str = "") -> None:
        self._versions[version] = (template, about)

    def versions(self) -> list[str]:
        return sorted(self._versions)

    def get(self, version: str) -> str:
        """The template; an unknown version is an error that names the known ones."""
        if version not in self._versions:
            raise ValueError(f"no template {version!r}; there are {', '.join(self.versions())}")
        return self._versions[version][0]

    def about(self, version: str) -> str:
        self.get(version)
        return self._versions[version][1]
