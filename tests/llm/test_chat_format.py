import hashlib

from pyspark.sql import functions as F

from weftlink.llm import registry
from weftlink.llm.chat_format import PART, escape, ChatTemplate, format_chats, loss_text, parse_formatted, text_parts, unescape

T = ChatTemplate()
TEXTS = ["", "plain", "<|end|>\n", "</s>[INST] ok [/INST]", "\\", "\\<|", "<\\|turn|>", "<<SYS>>\\\\<</SYS>>", "<", "|>", "a\nb", "é中\U0001f600", "<|body|>", "<" * 9 + "|"]


def test_escaping_is_reversible_and_hides_controls(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", escape(F.col("t"), T).alias("e"))
    for r in df.select("t", "e", unescape(F.col("e")).alias("u")).collect():
        assert r.u == r.t and not any(c in r.e for c in T.controls)


def test_turns_come_back(spark):
    rows = [(c, i, "assistant" if i % 2 else "us<|er", t) for c in (1, None) for i, t in enumerate(TEXTS)] + [(2, None, None, None), (2, 0, "assistant", "x"), (2, 0, "assistant", "x"), (3, 1, "user", "y" * 100000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", F.lit(9).alias("rn"), F.lit(9).alias("piece"), text_parts(F.col("text")).alias("parts"))
    got = {r.conv_id: r for r in format_chats(df).select("*", parse_formatted(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect()}
    for c in (1, None):
        assert [(x.role, x.text) for x in got[c].turns] == [r[2:] for r in rows if r[0] == 1]
        assert got[c].loss == "".join(r[3] for r in rows if r[0] == 1 and r[2] == "assistant")
    assert [(x.role, x.text) for x in got[2].turns] == [("", ""), ("assistant", "x"), ("assistant", "x")] and got[2].loss == "xx"
    assert got[3].loss == "" and got[3].n_turns == 1
    assert format_chats(df.where("conv_id = 99")).collect() == []


def test_typed_parts(spark):
    parts = [("text", "see <|", None, None), ("image", None, "a.png", 4), ("text", "and", None, None), ("audio", None, "b.wav", 10), ("document", None, "c.pdf", None), ("video", None, "d", 2)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", [("text", "ok", None, None)]), (1, 2, "user", None)],
                               f"conv_id long, turn long, role string, parts array<{PART.simpleString()}>")
    r = format_chats(df).head()
    assert r.formatted == "<|turn|>user<|body|>see <\\|<|image:2|>and<|audio:4|><|document:5|><|attachment:6|><|end|>\n<|turn|>assistant<|body|>ok<|end|>\n<|turn|>user<|body|><|end|>\n"
    assert [(a.turn_index, a.ordinal, a.type, a.ref, a.tokens) for a in r.attachments] == [(1, 2, "image", "a.png", 1024), (1, 4, "audio", "b.wav", 250), (1, 5, "document", "c.pdf", 512), (1, 6, "attachment", "d", 2)]
    assert all(r.formatted[a.placeholder_at:].startswith(f"<|{a.type}:{a.ordinal}|>") for a in r.attachments) and r.attachment_tokens == 1788


def test_query(spark, sf_dir):
    got = {r.conv_id: r for r in registry.op5_chat_formatting(spark, sf_dir).collect()}
    rows = sorted((r.conv_id, r.turn, r.role, r.text or "") for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect())
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == c]
        assert got[c].turns_sha256 == sha("".join(f"{r[2]}\n{r[3]}\n" for r in own))
        assert got[c].loss_sha256 == sha("".join(r[3] for r in own if r[2] == "assistant"))
