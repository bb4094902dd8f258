"""Chat formatting: round trips and typed parts."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from vocatlas.llm import chat_format as C

PIECES = ["<|turn|>", "<|end|>", "</s>", "<s>", "[INST]", "[/INST]", "<\\|turn|>", "<\\\\|end|>", "[\\INST]", "\\", "<", "[", "|>", "\n", " ", "é", "😀", "<|image:1.0|>", "<|end|", "/s>", "\x00", "$1", "user"]


def texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randrange(9))) for _ in range(n)]


def test_escape_is_reversible_and_leaves_no_control(spark):
    given = texts(400, 1) + PIECES
    df = spark.createDataFrame([(t,) for t in given], "t string")
    got = df.select("t", C.escape(F.col("t")).alias("e"), C.unescape(C.escape(F.col("t"))).alias("u"), C.unescape_role(C.escape_role(F.col("t"))).alias("r")).collect()
    for r in got:
        assert r.u == r.t and r.r == r.t
        assert not any(c in r.e for c in ("<|turn|>", "<|end|>", "</s>", "<s>", "[INST]", "[/INST]", "<|image:1.0|>"))


def test_conversations_read_back(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "a\\n\nb", "<|turn|>"]), x) for c, t, x in zip([i // 5 for i in range(200)], [i * 3 % 5 for i in range(200)], texts(200, 3))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = C.format_conversations(df.select("conv_id", "turn", "role", C.text_parts(F.col("text")).alias("parts")))
    got = {r.conv_id: r for r in out.select("*", C.parse(F.col("formatted")).alias("back")).collect()}
    for c in range(40):
        want = [(r[2], r[3]) for r in sorted(x for x in rows if x[0] == c)]
        assert [tuple(t) for t in got[c].back] == want
        assert "".join(s.text for s in got[c].segments) == got[c].formatted
        assert len([s for s in got[c].segments if s.loss]) == sum(role == "assistant" for role, _ in want)


def test_typed_parts(spark):
    parts = [
        ("text", "see </s>", None, None, None, None, None), ("image", None, "s3://a.png", 57, 28, None, None), ("audio", None, "b.wav", None, None, 1.5, None), ("video", "x", "y", None, None, None, None),
        ("document", None, "c.pdf", None, None, None, 3), ("image", None, None, None, None, None, None), None, ("text", None, None, None, None, None, None), (None, "z", None, None, None, None, None),
    ]
    df = spark.createDataFrame([(1, 2, "user", parts), (1, 1, None, None), (None, None, "assistant", [parts[1]])], f"conv_id long, turn long, role string, parts array<{C.PART}>")
    got = {r.conv_id: r for r in C.format_conversations(df).collect()}
    assert got[1].formatted == "<|turn|>\n<|end|>\n<|turn|>user\nsee <\\/s><|image:2.1|><|audio:2.2|><|document:2.4|><|image:2.5|><|end|>\n"
    assert [tuple(a) for a in got[1].attachments] == [(2, 1, "image", "s3://a.png", 3), (2, 2, "audio", "b.wav", 38), (2, 4, "document", "c.pdf", 1536), (2, 5, "image", None, 1)]
    assert got[None].formatted == "<|turn|>assistant\n<|image:-.0|><|end|>\n" and got[None].segments[1].loss


def test_query_on_odd_rows(spark, tmp_path):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "b"), (None, None, None, None), (2, 5, "assistant", "</s>"), (2, None, "user", "é")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in C.op4_chat_format(spark, str(tmp_path)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert (got[1].n_turns, got[1].turns_sha256, got[1].loss_chars, got[1].loss_sha256) == (3, sha("user\n\nassistant\nb\nassistant\nb\n"), 2, sha("bb"))
    assert got[None].turns_sha256 == sha("\n\n") and got[None].loss_chars == 0
    assert got[2].turns_sha256 == sha("user\né\nassistant\n</s>\n") and got[2].loss_sha256 == sha("</s>")
    assert got[-1].n_turns == 2 and got[-1].loss_sha256 == sha(C.PLANTED)


def test_no_conversations(spark):
    df = spark.createDataFrame([], f"conv_id long, turn long, role string, parts array<{C.PART}>")
    assert C.format_conversations(df).isEmpty()


@pytest.mark.parametrize("word", ["Python", "Arrow", "Pandas"])
def test_plan_is_native(spark, tmp_path, word):
    spark.createDataFrame([(1, 1, "user", "b")], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    plan = C.op4_chat_format(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert f"{word}Eval" not in plan and f"MapIn{word}" not in plan
