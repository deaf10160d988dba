from hypothesis import given
from hypothesis import strategies as st
from llm.helpers import same_as_oracle

from tillcycle.llm import reply_trees as rt

MESSAGES = "tree long, node long, parent long, role string, text string, score double"
tricky = st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "[", "/", "s>", "INST]", ":", "%",
                                   "é", "\n", "a"]), max_size=12).map("".join)


@given(st.lists(st.tuples(st.one_of(st.just("assistant"), tricky), tricky), max_size=5))
def test_formatting_is_reversible(turns):
    text, spans = rt.format_turns(turns)
    assert rt.parse(text) == turns
    assert [rt.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_best_branch_of_each_tree(spark):
    rows = [(1, 1, None, "user", "root", 0.0), (1, 2, 1, "assistant", "bad", -1.0), (1, 3, 1, "assistant", "good", 2.0),
            (1, 4, 2, "user", "deep", 2.5), (1, 5, 3, "user", None, None), (1, 6, 3, "user", "tie", 0.0),
            (2, 1, 99, "user", "unknown parent", None), (2, 2, 3, "x", "cycle", 1.0), (2, 3, 2, "x", "cycle", 1.0),
            (None, 1, None, None, "null tree", 1.0), (None, 2, 1, "assistant", "answer", 1.0)]
    rows += [(3, i, i - 1 if i else None, "user", f"t{i}", 1.0) for i in range(37)]
    df = spark.createDataFrame(rows + rows[:4], MESSAGES).withColumn("hops", rt.F.lit("clash"))
    out = {r["tree"]: r for r in rt.format_trees(df).collect()}
    assert {t: (r["leaf"], r["score"]) for t, r in out.items()} == {1: (5, 2.0), 2: (1, 0.0), 3: (36, 37.0), None: (2, 2.0)}
    assert rt.parse(out[1]["formatted"]) == [("user", "root"), ("assistant", "good"), ("user", "")]
    assert [t for _, t in rt.parse(out[3]["formatted"])] == [f"t{i}" for i in range(37)]
    assert rt.parse(out[None]["formatted"]) == [("", "null tree"), ("assistant", "answer")]
    two = {(r["tree"], r["rank"]): r["leaf"] for r in rt.format_trees(df, top=2).collect()}
    assert two[1, 1] == 5 and two[1, 2] == 6 and (2, 2) not in two


def test_conversations_with_repeated_turns_and_empty(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "system", None), (None, 1, "assistant", "</s>")]
    got = {r["tree"]: r["n_turns"] for r in rt.read_back(rt.format_trees(
        rt.of_conversations(spark.createDataFrame(rows, schema)))).collect()}
    assert got == {1: 3, None: 1}
    assert rt.format_trees(rt.of_conversations(spark.createDataFrame([], schema))).count() == 0


def test_query(spark):
    same_as_oracle(spark, "op7_reply_trees")
