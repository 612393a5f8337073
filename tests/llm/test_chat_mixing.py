import hashlib

from cindersift.llm import chat, mixing
from cindersift.llm.common import table
from pyspark.sql import functions as F


def test_reply_tree_paths_and_ranks(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "a", 1.0), (1, 3, 1, "assistant", "b", 3.0), (1, 4, 3, "user", "more", 0.0), (1, 5, 4, "assistant", None, 2.0),
            (2, 1, 9, "user", "orphan", None), (3, 1, 2, "user", "cycle", 0.0), (3, 2, 1, "user", "cycle", 0.0), (3, 3, 2, "user", "tail", 0.0), (4, None, None, "user", "no id", 0.0)]
    m = spark.createDataFrame(rows, "conv_id long, msg_id long, parent_id long, role string, text string, score double")
    got = {(r.conv_id, r.leaf): r for r in chat.conversations(m).collect()}
    assert set(got) == {(1, 2), (1, 5), (2, 1)}
    assert [t.text for t in got[1, 5].turns] == ["q", "b", "more", ""] and got[1, 5].rank == 1 and got[1, 2].rank == 2
    assert {r.leaf for r in chat.conversations(m, best=1).where("conv_id = 1").collect()} == {5}
    assert chat.conversations(m.limit(0)).count() == 0


def test_long_chain_needs_few_rounds(spark):
    m = spark.range(1, 301).select(F.lit(1).alias("conv_id"), F.col("id").alias("msg_id"), F.when(F.col("id") > 1, F.col("id") - 1).alias("parent_id"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"), F.lit(0.0).alias("score"))
    row = chat.conversations(m).first()
    assert [t.text for t in row.turns] == [str(i) for i in range(1, 301)]


def test_round_trip_of_control_strings(spark):
    said = ["</s>[INST] ok [/INST]", "<\\s> <\\\\s> [INST] <<SYS>> <|im_end|>\n<|im_start|>user\nhi", "", None, "plain < [ text", "<|im_end|>\n"]
    rows = [(i // 3, i, ("assistant", "user", "a%0A\n<|im_start|>")[i % 3], t) for i, t in enumerate(said)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for r in chat.digest(turns).collect():
        own = [(role, t or "") for c, _, role, t in rows if c == r.conv_id]
        assert r.n_turns == len(own)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for a, t in own).encode()).hexdigest()
        loss = "".join(t for a, t in own if a == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    text = chat.conversations(chat.linear(turns)).select("formatted").collect()
    assert all(r.formatted.count("[INST]") + r.formatted.count("</s>") == 0 for r in text)


def test_ties_nulls_and_repeated_turns(spark):
    rows = [(None, 1, "user", "x"), (5, None, None, None), (5, 1, "user", "b"), (5, 1, "user", "a"), (5, 1, "user", "a")]
    got = {r.conv_id: r.n_turns for r in chat.digest(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {None: 1, 5: 4}


def test_raking_meets_all_marginals(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = mixing.digest(docs).toPandas()
    total = got.n_tokens.sum()
    got["mass"] = got.rate * got.n_tokens
    for dim, alpha in mixing.ALPHAS.items():
        share = got.groupby(dim).n_tokens.sum() / total
        want = share**alpha / (share**alpha).sum()
        have = got.groupby(dim).mass.sum() / got.mass.sum()
        assert ((have - want).abs() < 0.01).all()
    assert abs(got.mass.sum() / total - mixing.BUDGET) < 0.01


def test_distributed_raking_agrees_with_the_small_one(spark, sf):
    docs = table(spark, sf, "documents")
    few = sorted(map(tuple, mixing.calibrate(docs, rounds=3).select("doc_id", "rate", "copies").collect()))
    many = sorted(map(tuple, mixing.calibrate(docs, rounds=3, small=0).select("doc_id", "rate", "copies").collect()))
    assert all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-5 and a[2] == b[2] for a, b in zip(few, many, strict=True))


def test_mixing_edges(spark):
    rows = [(1, None, None, None), (2, "", "en", "s"), (3, "a b", "en", "s"), (3, "a b", "en", "s"), (None, "c", "de", None)]
    got = mixing.digest(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert len(got) == 5 and {r.source for r in got} == {"(none)", "s"} and all(r.rate == 0 for r in got if r.n_tokens == 0 and r.doc_id == 1)
    assert mixing.digest(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0
