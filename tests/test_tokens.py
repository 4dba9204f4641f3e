"""Token arrays: the merge golden row, labels, truncation, tokenizer."""

from pyspark.sql import functions as F

from tessera.functions import arrays as AR
from tessera.operators.tokens import build_vocab, decode_ids, tokenize, word_tokens

MERGE_IDS = [2, 255999, 8, 8, 8, 256000, 100, 200, 300]


def test_merge_golden_row(spark):
    df = spark.createDataFrame([(MERGE_IDS,)], "ids array<int>")
    r = df.select(AR.count_true(AR.image_mask("ids")).alias("n_img"),
                  AR.mask_labels("ids", F.lit(2)).alias("labels"),
                  AR.attention_mask("ids").alias("att"),
                  AR.image_mask("ids", F.lit(4)).alias("live")).first()
    assert r["n_img"] == 3
    assert r["labels"] == [-100, -100] + MERGE_IDS[2:]
    assert r["att"] == [1] * len(MERGE_IDS)
    assert r["live"] == [False, False, True, True, False, False, False, False, False]


def test_truncate_and_normalize(spark):
    df = spark.createDataFrame([([1, 2, 3], [9]), ([1, 2, 3], [1, 2, 3, 9])], "inp array<int>, out array<int>")
    rows = df.select(AR.normalize_output("inp", "out").alias("o"), AR.truncate("inp", 2).alias("t")).collect()
    assert rows[0]["o"] == [1, 2, 3, 9] and rows[1]["o"] == [1, 2, 3, 9]
    assert rows[0]["t"] == [1, 2]
    n = df.select(AR.new_tokens(AR.normalize_output("inp", "out"), F.lit(3)).alias("n")).collect()
    assert [r["n"] for r in n] == [[9], [9]]


def test_tokenize_separately_and_decode(spark):
    docs = spark.createDataFrame([(1, "the cat sat on the mat"), (2, "the dog")], "doc_id long, text string")
    vocab = build_vocab(docs)
    v = {r["t"]: r["id"] for r in vocab.collect()}
    assert v["the"] == 16 and min(v.values()) == 16          # ids start after the reserved block
    s = spark.createDataFrame([(7, "[@BOS@]<|image_soft_token|><|image_soft_token|> the", "cat unknownword")],
                              "k long, p string, a string")
    t = tokenize(s, "k", ["p", "a"], vocab, hot_size=2).first()   # hot + tail lookup paths
    assert t["input_ids"] == [2, 8, 8, v["the"], v["cat"], 0]
    assert t["n_prompt"] == 4
    d = decode_ids(s.withColumn("ids", F.array(*[F.lit(i) for i in t["input_ids"]])), "k", "ids", vocab, "txt").first()
    assert d["txt"] == "the cat"


def test_word_tokens_keep_specials_atomic(spark):
    r = spark.createDataFrame([("<|start_of_turn|>user\nhi, there!",)], "s string") \
        .select(word_tokens("s").alias("t")).first()["t"]
    assert r == ["<|start_of_turn|>", "user", "hi", ",", "there", "!"]


def test_plugin_tokenizer(spark):
    """A user tokenizer runs batch-wise through Arrow."""
    from tessera.operators.tokens import tokenize_with

    def encode(texts):
        return [[len(w) for w in t.split()] for t in texts]
    df = spark.createDataFrame([("ab c",), ("",), (None,)], "s string")
    got = [r["ids"] for r in tokenize_with(df, "s", encode, "ids").collect()]
    assert got == [[2, 1], [], []]


def test_tokenize_truncates_while_collecting(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    vocab = build_vocab(docs)
    s = spark.createDataFrame([(1, "a b c", "d e f")], "k long, p string, a string")
    full = tokenize(s, "k", ["p", "a"], vocab).first()
    cut = tokenize(s, "k", ["p", "a"], vocab, max_length=4).first()
    assert cut["input_ids"] == full["input_ids"][:4] and cut["n_prompt"] == full["n_prompt"] == 3
    cut2 = tokenize(s, "k", ["p", "a"], vocab, max_length=2).first()
    assert cut2["input_ids"] == full["input_ids"][:2] and cut2["n_prompt"] == 3


def test_prompt_template_equals_tokenized_string(spark):
    """Assembled ids == tokenising the rendered prompt, including text that
    ends in template-like fragments."""
    from tessera import constants as K
    from tessera.functions.prompts import render_prompt
    from tessera.operators.tokens import PromptTemplate
    docs = spark.createDataFrame([(1, "user assistant system the cat a b")], "doc_id long, text string")
    vocab = build_vocab(docs)
    s = spark.createDataFrame([(1, "the cat", 3), (2, "a <|end", 1), (3, "", 0), (4, "x <", 2)],
                              "k long, u string, n int")
    tpl = PromptTemplate(spark, vocab, K.GROUNDING_SYSTEM_PROMPT)
    u = tokenize(s, "k", ["u"], vocab, "uids", "nu")
    got = {r["k"]: r["ids"] for r in u.select("k", tpl.prompt_ids("uids", "n").alias("ids")).collect()}
    r = s.withColumn("p", render_prompt("u", F.col("n"), F.lit(K.GROUNDING_SYSTEM_PROMPT)))
    want = {x["k"]: x["input_ids"] for x in tokenize(r, "k", ["p"], vocab).collect()}
    assert got == want


def test_placeholder_in_user_text_cache_drops_live_fails(spark):
    """A user text that itself contains a placeholder: the cache path counts
    placeholders over the whole sequence and drops the row; the processor
    rule counts the prompt and fails."""
    import pytest
    from tessera.functions.prompts import answer_text, render_prompt
    from tessera.operators.gates import check_alignment
    docs = spark.createDataFrame([(1, "hello world")], "doc_id long, text string")
    vocab = build_vocab(docs)
    s = spark.createDataFrame([(1, "hello", "world", 2), (2, "see <|image_soft_token|>", "ok", 2)],
                              "k long, u string, a string, n int")
    s = s.select("k", "n", render_prompt("u", F.col("n")).alias("p"), answer_text("a").alias("ans"))
    t = tokenize(s, "k", ["p", "ans"], vocab).withColumn("n_img", AR.count_true(AR.image_mask("input_ids")))
    assert [r["k"] for r in check_alignment(t, "n_img", "n", "drop").collect()] == [1]
    with pytest.raises(Exception, match="image token count mismatch"):
        check_alignment(t, "n_img", "n", "fail").collect()
