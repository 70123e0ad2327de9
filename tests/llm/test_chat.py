import hashlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meterlake.llm.chat import ChatTemplate, format_conversations, read_back, unescape

CONV = "conv_id bigint, turn bigint, role string, text string, pieces string, messages string"
CONTROLS = ChatTemplate().controls


def turns_of(df):
    out = format_conversations(df).select(
        "conv_id", read_back(F.col("formatted")).alias("turns"), F.size("messages").alias("m"),
        unescape(F.concat_ws("", F.transform(F.filter("pieces", lambda p: p["loss"]), lambda p: p["text"]))).alias("loss"), "formatted",
    )
    return {r["conv_id"]: ([(t["role"], t["text"]) for t in r["turns"]], r["m"], r["loss"], r["formatted"]) for r in out.collect()}


def test_round_trip_merging_and_mask(spark):
    rows = [
        (1, 2, "assistant", "b"), (1, 1, "user", "a\\"), (1, 3, "assistant", None), (1, 4, None, "x<|im_end|>"),
        (2, None, "user", "<|im_start|>user<|im_sep|>"), (2, 1, "user", ""), (2, 1, "user", ""), (None, 1, "assistant", "</s>[INST] ok [/INST]"), (3, 1, "user", "long " * 50000),
    ]
    got = turns_of(spark.createDataFrame([(*r, "p", "q") for r in rows], CONV))
    assert got[1][0] == [("user", "a\\"), ("assistant", "b"), ("assistant", ""), ("", "x<|im_end|>")]
    assert got[1][1] == 3 and got[1][2] == "b"
    assert got[2][0] == [("user", "<|im_start|>user<|im_sep|>"), ("user", ""), ("user", "")] and got[2][1] == 1
    assert got[None][2] == "</s>[INST] ok [/INST]" and "[INST]" not in got[None][3]
    assert got[3][0] == [("user", "long " * 50000)]
    assert turns_of(spark.createDataFrame([], CONV)) == {}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\\<|im_sep|>"]), st.lists(st.sampled_from([*CONTROLS, "\\", "<", "|im_end|>", "[", "é", "\n", "x"]), max_size=6).map("".join)), min_size=1, max_size=5), min_size=1, max_size=12))
def test_any_text_comes_back(spark, conversations):
    rows = [(c, t, role, text, "", "") for c, turns in enumerate(conversations) for t, (role, text) in enumerate(turns)]
    got = turns_of(spark.createDataFrame(rows, CONV))
    for c, turns in enumerate(conversations):
        assert got[c][0] == turns
        assert got[c][2] == "".join(text for role, text in turns if role == "assistant")


def test_query_digests(spark, tmp_path):
    from meterlake.llm.chat import op1_chat_format

    rows = [(5, 1, "user", "q"), (5, 2, "assistant", "é</s>"), (5, 3, "assistant", None)]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r for r in op1_chat_format(spark, str(tmp_path)).collect()}
    said = "user\nq\nassistant\né</s>\nassistant\n\n"
    assert got[5]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert (got[5]["n_turns"], got[5]["loss_chars"]) == (3, 5)
    assert got[-1]["loss_sha256"] == hashlib.sha256(b"</s>[INST] ok [/INST]").hexdigest() and got[-1]["n_turns"] == 2
