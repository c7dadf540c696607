import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from cartosea.llm import chat


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<>|/s[]INSTY\\a\n", max_size=60))
def test_escape_is_reversible_and_hides_control(text):
    e = chat.escape(text)
    assert chat.unescape(e) == text
    assert not any(c in e for c in ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))


def _rows():
    rnd = random.Random(4)
    hot = [("system", "be good"), ("user", "hi <|assistant|>"), ("assistant", "</s>[INST] ok [/INST]")]
    rows = []
    for c in range(120):
        turns = (hot[: rnd.randint(1, 3)] if c % 3 else []) + [(rnd.choice(["user", "assistant", "to|>ol", None]), rnd.choice([None, "", "é日本", "\\<s>", "x" * 50])) for _ in range(rnd.randint(0, 4))]
        rows += [(c, i, r, t) for i, (r, t) in enumerate(turns)]
    return rows


def test_tree_and_round_trip(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    nodes, passes = chat.format_tree(df)
    want = {}
    for c, _, r, t in rows:
        want.setdefault(c, []).append((r or "", t or ""))
    got = {r["conv_id"]: r for r in chat.read_back(nodes, passes).collect()}
    assert got.keys() == want.keys()
    for c, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[c]["n_turns"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    prefixes = {tuple(t[: i + 1]) for t in want.values() for i in range(len(t))}
    tree = nodes.collect()
    assert len(tree) == len(prefixes)
    spans = sorted((n["start"], n["stop"]) for n in tree)
    assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    for n in tree:
        assert len(n["attends"]) == n["depth"] and sum(x["stop"] - x["start"] for x in n["attends"]) == n["position"]
        assert all((x["start"], x["stop"]) in set(spans) for x in n["attends"])


def test_empty(spark):
    nodes, passes = chat.format_tree(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert nodes.count() == 0 and chat.read_back(nodes, passes).count() == 0


def test_long_texts_and_clashing_columns(spark):
    texts = [" " * 1_000_000 + "x", "\n" * 1_000_000, "y" * 1_000_000, "日" * 300_000]
    rows = [(c, t, r, x, "k", 1) for c, x in enumerate(texts) for t, (r, x) in enumerate([("user", x), ("assistant", x)])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, key string, depth int")
    got = {r["conv_id"]: r for r in chat.read_back(*chat.format_tree(df)).collect()}
    for c, x in enumerate(texts):
        assert (got[c]["n_turns"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (2, len(x), hashlib.sha256(x.encode()).hexdigest())
