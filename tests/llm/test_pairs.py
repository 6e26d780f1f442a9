"""Defects of prompt and response pairs."""

from __future__ import annotations

import json
import time

import pytest
from pyspark.sql import functions as F

from skyloom.llm.pairs import find_defects, flag_pairs, is_copied, is_refusal
from skyloom.session import local_session

RESULT = json.dumps([{"cluster_id": 1, "master": 111, "sats": [111], "targets": [5]}])
SOUND = "Satellite 111 sees target 5 with quality 0.9. Satellite 112 is linked to 111 with 0.8, so both form one cluster. Its master is 111, as it is healthy."
TASK = "Partition the satellites of the snapshot into clusters and name the master of each."


@pytest.mark.parametrize(
    "text",
    [
        "I'm sorry, but I can't help with that.", "I would rather not take this on.", "As an AI language model I have no access to spacecraft.", "我无法完成这项任务。", "抱歉，我看了36颗卫星和50个目标，但我不能给出方案。",
        "Es tut mir leid, ich kann Ihnen dabei nicht helfen.", "Je ne peux pas répondre à cette demande.", "No puedo ayudar con esta tarea.", "Mi dispiace, non posso aiutare.", "Infelizmente não posso ajudar.",
        "Извините, я не могу выполнить это задание.", "申し訳ありませんが、お手伝いできません。", "죄송하지만 도와드릴 수 없습니다.", "This is not one I am comfortable completing.",
    ],
)
def test_refusals(text):
    assert is_refusal(text)


@pytest.mark.parametrize(
    "text",
    [
        "我们无法让卫星111直接连接目标5,因此改由卫星112承担，簇1包含112和113。", "I cannot group satellite 5 with satellite 9 because there is no edge, so they form two clusters.",
        "The target lies beyond the scope of satellite 3, which leaves satellite 4.", "We can't merge these groups: their link is weak. Cluster 1 has 5 satellites. Cluster 2 has 6.",
        "不能合并：簇1与簇2之间没有强链路。簇1选择111为主星。簇2选择121为主星。", "Unfortunately 111 cannot reach target 7; 112 can. 112 is therefore master of group 2.",
        "I decline to merge 1 and 2, since w is 0.3. Group 1 keeps 111 and 112. Group 2 keeps 121. Master of 1 is 112.", SOUND, "", None,
    ],
)
def test_sound_reasoning_that_says_cannot(text):
    assert not is_refusal(text)


def test_each_defect_and_all_of_them():
    assert find_defects(TASK, "{}", SOUND, RESULT) == []
    assert find_defects(TASK, "{}", f"Task: {TASK}", RESULT) == ["copied"]
    assert find_defects(TASK, "{}", "卫星111可见目标5，卫星112与111相连，故二者同簇，主星为111，其健康度最高。", RESULT) == ["other_language"]
    assert find_defects(TASK, "{}", "", RESULT) == ["empty"] and find_defects(TASK, "{}", SOUND, " [] ") == ["empty"]
    assert find_defects(TASK, "{}", SOUND[:-20], RESULT) == ["truncated"] and find_defects(TASK, "{}", SOUND, RESULT[:-9]) == ["truncated"]
    assert find_defects(TASK, None, "I'm sorry, but I can't help with", None) == ["refusal", "empty", "truncated"]


def test_the_copy_test_is_linear():
    source = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(300_000))
    began = time.perf_counter()
    assert is_copied(source[:150_000] + "x" + source[150_000:], (source,)) and not is_copied(source[::-1], (source,))
    assert time.perf_counter() - began < 5


def test_table_with_nulls_copies_and_clashing_names():
    spark = local_session(4, 4)
    schema = "record_id long, i string, u string, r string, o string, defects string"
    rows = [(1, TASK, "{}", SOUND, RESULT, "x"), (1, TASK, "{}", SOUND, RESULT, "x"), (2, None, None, None, None, None), (None, TASK, "{}", "", RESULT, "x")]
    found = flag_pairs(spark.createDataFrame(rows, schema), "record_id", "i", "u", "r", "o").orderBy(F.col("record_id").asc_nulls_last())
    assert [tuple(r) for r in found.collect()] == [(1, []), (2, ["empty"]), (None, ["empty"])]
    assert flag_pairs(spark.createDataFrame([], schema), "record_id", "i", "u", "r", "o").collect() == []
