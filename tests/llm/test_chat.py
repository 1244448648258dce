import hashlib

from framewise.llm import chat

COLS = "conv_id long, turn long, role string, text string"


def test_digests_of_awkward_conversations(spark):
    rows = [(1, 0, "user", "<|end|>&lt;|<|text|> \\ &amp;"), (1, 1, "assistant", "a<|turn|>b"), (1, 2, None, None), (1, 3, "assistant", None), (1, 4, "assistant", "é🙂"),
            (2, 5, "assistant", ""), (None, 1, "user", "u"), (None, 0, "assistant", "v"), (3, 0, "as<|x", "t"), (3, 0, "as<|x", "t"), (4, None, "user", "x" * 50_000)]
    got = {r.conv_id: r for r in chat.conversation_digests(spark.createDataFrame(rows, COLS)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        g = got[conv]
        assert (g.n_turns, g.turns_sha256) == (len(own), sha("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)))
        assert (g.loss_chars, g.loss_sha256) == (len(loss), sha(loss))
    assert len(got) == 5


def test_columns_of_other_names_and_an_id_that_reads_null(spark):
    rows = [("null", 0, "user", "a", "x", 1), ("null", 1, "assistant", "b", None, 2), (None, 0, "user", "c", "y", 3), (None, 1, "assistant", "d", "z", None)]
    kinds = "conv_id string, turn long, role string, text string, node string, tree int"
    got = {r.conv_id: (r.n_turns, r.loss_chars, r.loss_sha256) for r in chat.conversation_digests(spark.createDataFrame(rows, kinds)).collect()}
    assert got == {i: (2, 1, hashlib.sha256(t.encode()).hexdigest()) for i, t in (("null", "b"), (None, "d"))}


def test_empty_table(spark):
    assert chat.conversation_digests(spark.createDataFrame([], COLS)).collect() == []


def test_paths_of_trees_orphans_and_loops(spark):
    nodes = [("t", "r", None, 0.0), ("t", "a", "r", 1.0), ("t", "b", "r", 5.0), ("t", "c", "b", 5.0), ("t", "d", "b", 9.0), ("u", "o", "gone", 1.0),
             ("v", "x", "y", 1.0), ("v", "y", "x", 1.0), ("v", "z", "x", 1.0)]
    rows = [(t, n, p, "assistant" if n in "ad" else "user", f"text {n}", s) for t, n, p, s in nodes]
    table = spark.createDataFrame(rows, "tree string, node string, parent string, role string, text string, score double")
    found = {}
    for r in chat.paths(table).collect():
        found.setdefault(r.leaf, []).append((r.up, r.node))
    assert {k: [n for _, n in sorted(v, reverse=True)] for k, v in found.items()} == {"a": ["r", "a"], "c": ["r", "b", "c"], "d": ["r", "b", "d"], "o": ["o"]}
    best = chat.read_back(chat.format_trees(table, keep=2)).collect()
    assert {(r.tree, r["rank"], r.leaf) for r in best} == {("t", 1, "d"), ("t", 2, "c"), ("u", 1, "o")}
    top = next(r for r in best if r.leaf == "d")
    assert [(t.role, t.text) for t in top.turns] == [("user", "text r"), ("user", "text b"), ("assistant", "text d")] and top.loss_text == "text d"


def test_long_thread_is_one_path(spark):
    rows = [(9, i, "user" if i % 2 == 0 else "assistant", f"m{i}") for i in range(700)]
    (r,) = chat.conversation_digests(spark.createDataFrame(rows, COLS)).collect()
    assert r.n_turns == 700 and r.loss_chars == len("".join(f"m{i}" for i in range(1, 700, 2)))
