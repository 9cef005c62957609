"""Operators over embeddings and conversations."""

import hashlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from phasewell.llm import chat, embed_dedup, graph, topk

SCHEMA = "vec_id long, embedding array<float>, label int, id string, n_links string, vector string, score string"


def _vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, None, None, None, None) for i, v in rows], SCHEMA)


def _usable(rows):
    return {i: np.array(v, np.float32).astype(float) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)}


def test_topk_is_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 0.2, 16).tolist()) for i in range(700)] + [(700 + i, [0.25] * 16) for i in range(60)]  # ties
    rows += [(2000, None), (2020, [None] * 16), (2040, [float("nan")] * 16), (2060, [float("inf")] * 16), (2080, [0.5] * 3), (2081, [0.25] * 3), (None, [0.1] * 16)]
    got = topk.top_k(_vectors(spark, rows), F.col("id") % 20 == 0, 20, scale=64.0).collect()
    ints = {i: np.floor(64 * v).astype(int) for i, v in _usable(rows).items() if i is not None}
    wanted = []
    for q, x in ints.items():
        if q % 20 == 0:
            best = sorted((-int(x @ y), i) for i, y in ints.items() if i != q and len(y) == len(x))[:20]
            wanted += [(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    assert sorted(tuple(r) for r in got) == sorted(wanted)
    assert topk.top_k(_vectors(spark, []), F.col("id") % 20 == 0, 20).count() == 0


def test_topk_bounds_hold():
    rng = np.random.default_rng(5)
    x, q = rng.normal(size=(200, 30)) + 1, rng.normal(size=(20, 30))
    for parts in (1, 4, 16):
        bound = topk._statistics(q, parts) @ topk._statistics(x, parts).T
        assert (bound >= q @ x.T - 1e-9).all()


def test_embedding_duplicates_against_all_cosines(spark, monkeypatch):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 12))
    rows = [(i, (centres[i % 40] + rng.normal(0, 0.15, 12)).tolist()) for i in range(600)] + [(600 + i, centres[0].tolist()) for i in range(30)]
    rows += [(2000, None), (2001, [0.0] * 12), (2002, [None] * 12), (2003, [float("nan")] * 12), (2004, []), (2005, [1.0, 2.0]), (2006, [2.0, 4.0])]
    vectors = {i: v / np.linalg.norm(v) for i, v in _usable(rows).items() if len(v) and np.abs(v).max() > 0}
    links = {i: [j for j, w in vectors.items() if j != i and len(w) == len(v) and v @ w >= 0.9] for i, v in vectors.items()}
    component = {}
    for i in sorted(vectors):
        if i not in component:
            stack = [i]
            while stack:
                if (j := stack.pop()) not in component:
                    component[j] = i
                    stack += links[j]
    df = _vectors(spark, rows)
    monkeypatch.setattr(embed_dedup, "BLOCK", 50)
    got = {r["vec_id"]: r for r in embed_dedup.near_duplicates(df).collect()}
    assert len(got) == len(rows)
    for i, r in got.items():
        assert (r["n_links"], r["component_id"]) == (len(links.get(i, [])), component.get(i, i)) and r["kept"] == (r["component_id"] == i)
    cells = embed_dedup.near_duplicates(df, cell=40).collect()  # many cells: an index
    found, every = sum(r["n_links"] for r in cells), sum(map(len, links.values()))
    assert all(r["n_links"] <= len(links.get(r["vec_id"], [])) for r in cells) and found >= 0.95 * every
    assert embed_dedup.near_duplicates(_vectors(spark, [])).count() == 0


def test_embedding_recall_on_the_tables(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    data = df.collect()
    x = np.array([r["embedding"] for r in data], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    every = int((x @ x.T >= 0.9).sum() - len(x))
    found = embed_dedup.near_duplicates(df, cell=100).agg(F.sum("n_links")).first()[0]
    assert 0.95 * every <= found <= every


@pytest.mark.parametrize("cells", [300, 2_048])
def test_embedding_pairs_at_the_threshold_share_a_cell(cells):
    """Pairs planted at cosines 0.90 to 0.92, with as many cells as large tables have."""
    rng = np.random.default_rng(11)
    unit = lambda n: (v := rng.normal(size=(n, 64))) / np.linalg.norm(v, axis=1, keepdims=True)
    centroids = embed_dedup.fit_cells(unit(embed_dedup.SAMPLE * cells), cells, rounds=4)
    a, other = unit(2_000), unit(2_000)
    other -= (other * a).sum(1, keepdims=True) * a
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    cosine = rng.uniform(0.9, 0.92, (len(a), 1))
    both = np.concatenate([a, cosine * a + np.sqrt(1 - cosine**2) * other])
    ids = pa.array(range(len(both)), pa.int64())
    batch = pa.record_batch([ids, ids, pa.array(both.tolist(), pa.list_(pa.float64()))], ["id", "times", "vector"])
    (out,) = embed_dedup._assigned(SimpleNamespace(value={64: centroids}), embed_dedup.MARGIN)([batch])
    shown = [set(c) for c in out.column("cells").to_pylist()]
    met = [bool(shown[i] & shown[len(a) + i]) for i in range(len(a))]
    assert np.mean(met) >= 0.99


def test_embedding_pairs_count_once_in_the_first_shared_cell():
    """In whichever cell two vectors first meet, also one that is neither's own; many cells, pairs near the threshold."""
    rng = np.random.default_rng(12)
    a = rng.normal(size=(1_000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    other = rng.normal(size=a.shape)
    other -= (other * a).sum(1, keepdims=True) * a
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    both = np.concatenate([a, 0.91 * a + np.sqrt(1 - 0.91**2) * other])
    centroids = embed_dedup.fit_cells(np.concatenate([a, rng.normal(size=(7_000, 64)) / 8]), 300, rounds=4)
    ids = pa.array(range(len(both)), pa.int64())
    batch = pa.record_batch([ids, pa.array([1] * len(both), pa.int64()), pa.array(both.tolist(), pa.list_(pa.float64()))], ["id", "times", "vector"])
    (out,) = embed_dedup._assigned(SimpleNamespace(value={64: centroids}), 0.04)([batch])
    shown = [set(c) for c in out.column("cells").to_pylist()]
    found = np.zeros(len(both), int)
    for cell in range(300):
        rows = pa.table(out).filter(pa.array([cell in c for c in shown]))
        n = len(rows)
        columns = {"cell": [cell] * n, "i": [0] * n, "j": [0] * n, "own": [0] * n}
        for name, values in columns.items():
            rows = rows.append_column(name, pa.array(values, pa.int64()))
        result = embed_dedup._compared(0.9)(rows) if n else None
        if result is not None:
            for u, v, k in zip(*(result.column(c).to_pylist() for c in "uvn"), strict=True):
                found[u] += k if u == v else 0
    met = np.array([bool(shown[i] & shown[len(a) + i]) for i in range(len(a))])
    home = [set(c) for c in (both @ centroids.T).argmax(1)[:, None].tolist()]
    third = [i for i in np.flatnonzero(met) if not shown[i] & shown[len(a) + i] & (home[i] | home[len(a) + i])]
    assert third  # pairs that meet only where both are guests
    assert (found == np.concatenate([met, met])).all()


def test_components_of_hard_graphs(spark):
    chain = [(i, i + 1) for i in range(0, 200)]
    star = [(1000, 1000 + i) for i in range(1, 100)]
    df = spark.createDataFrame([*chain, *star, (5, 5), (3000, 2000)], "u long, v long")
    got = {r["id"]: r["component"] for r in graph.components(df).collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(100)} | {2000: 2000, 3000: 2000}
    assert graph.components(df.limit(0)).count() == 0


CONVERSATIONS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "hello <|im_end|> <\\|x <\\\\| | <"), (2, 1, "assistant", "first"), (2, 0, "system", None), (2, 2, "user", ""),
    (3, 0, None, "no role"), (3, 0, "assistant", "same turn"), (3, 0, "assistant", "same turn"), (4, None, "odd\nrole%0A%25<|", "<|im_start|>user\n"), (None, 0, "user", "no id"),
    (-1, 0, "user", "<|im_end|><|im_start|>assistant ok"), (-1, 1, "assistant", "<|im_end|><|im_start|>assistant ok"), (5, 0, "user", "y" * 50_000), (5, 1, "assistant", "z" * 50_000),
]


@pytest.fixture(scope="module")
def conversations(spark):
    rows = [(*r, None, None) for r in CONVERSATIONS]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string, segments string")


def test_chat_reads_back(spark, conversations):
    by = {}
    for c, t, role, text in CONVERSATIONS:
        by.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    got = {r["conv_id"]: r for r in chat.digests(conversations).collect()}
    assert got.keys() == by.keys()
    for c, turns in by.items():
        turns.sort()
        said = "".join(x for _, role, x in turns if role == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["loss_chars"] == len(said)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert chat.digests(conversations.limit(0)).count() == 0


def test_chat_validates_and_segments(conversations):
    got = {r["conv_id"]: r for r in chat.format_conversations(conversations).collect()}
    assert got[1]["valid"] and got[-1]["valid"] and not got[2]["valid"] and got[2]["first_wrong"] == 1 and got[3]["first_wrong"] == 0
    assert got[-1]["formatted"].count("<|im_start|>") == 2 and got[-1]["formatted"].count("<|im_end|>") == 2
    assert [s["loss"] for s in got[1]["segments"]] == [False, False, False, False, True, False]
    assert "".join(s["text"] for s in got[1]["segments"]) == got[1]["formatted"]


OTHER = chat.Template(
    begin="[#turn ", after_role="]: ", end="{/turn}\n", loss_roles=("tool", "bot"), start="start", follows={"start": ("human",), "human": ("bot", "tool"), "tool": ("bot",), "bot": ("human",)}
)


def test_chat_follows_another_template(spark):
    """Its strings are escaped in texts, and its machine decides on order and loss."""
    rows = [
        (1, 0, "human", "ask [#turn bot]: {/turn}\n [\\# {\\/ ["), (1, 1, "tool", "{"), (1, 2, "bot", "[#{/"), (2, 0, "bot", "early"), (2, 1, "start", "odd]%5D]: [#"), (2, 2, "tool", ""),
        (3, 0, "human", "a"), (3, 1, "human", "b"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.format_conversations(df, OTHER).select("*", chat.read_back(F.col("formatted"), OTHER).alias("read")).collect()}
    for c in (1, 2, 3):
        assert [tuple(t) for t in got[c]["read"]] == [r[2:] for r in rows if r[0] == c]
        assert got[c]["formatted"].count(OTHER.begin) == got[c]["formatted"].count(OTHER.end) == got[c]["n_turns"]
    assert [(got[c]["valid"], got[c]["first_wrong"]) for c in (1, 2, 3)] == [(True, None), (False, 0), (False, 1)]
    assert [s["loss"] for s in got[1]["segments"]] == [False, False, False, False, True, False, False, True, False]
    assert [r["loss_chars"] for r in chat.digests(df, OTHER).orderBy("conv_id").collect()] == [5, 5, 0]
    for wrong in ({"begin": "<"}, {"end": "|x"}, {"after_role": "<"}, {"begin": "<<x"}, {"after_role": "%"}):
        with pytest.raises(ValueError, match="."):
            chat.Template(**wrong)


def test_chat_machine_is_in_the_plan(conversations):
    """The query's loss flags come from the fold over the roles."""
    plan = chat.digests(conversations)._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" in plan and "entered" in plan


def test_chat_of_many_turns(spark):
    n = 20_000
    df = spark.range(n).selectExpr("1L AS conv_id", "id AS turn", "IF(id % 2 = 0, 'user', 'assistant') AS role", "concat('<|', id) AS text")
    got = chat.digests(df).first()
    assert got["n_turns"] == n and got["loss_chars"] == sum(2 + len(str(i)) for i in range(1, n, 2))


def test_embedding_recall_with_the_usual_cells(spark):
    """Production parameters over several cells: planted pairs near the threshold, and one vector that a third of the rows share."""
    rng = np.random.default_rng(13)
    unit = lambda n: (v := rng.normal(size=(n, 64))) / np.linalg.norm(v, axis=1, keepdims=True)
    a, other = unit(1_500), unit(1_500)
    other -= (other * a).sum(1, keepdims=True) * a
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    near = 0.905 * a + np.sqrt(1 - 0.905**2) * other
    rows = np.concatenate([a, near, unit(4_000), np.repeat(unit(1), 3_000, 0)]).astype(np.float32)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r for r in embed_dedup.near_duplicates(df).collect()}
    assert len(got) == len(rows) and len(rows) - 3_000 > 3 * embed_dedup.CELL
    assert np.mean([got[i]["n_links"] == got[1_500 + i]["n_links"] == 1 and got[1_500 + i]["component_id"] == i for i in range(1_500)]) >= 0.99
    assert {(got[i]["n_links"], got[i]["component_id"]) for i in range(7_000, 10_000)} == {(2_999, 7_000)}
    assert not any(got[i]["n_links"] for i in range(3_000, 7_000))


def test_topk_prunes_level_by_level():
    """Vectors whose energy lies on few axes: the bounds leave few pairs, fewer at each level; the result stays exact."""
    rng = np.random.default_rng(15)
    basis = np.linalg.qr(rng.normal(size=(32, 32)))[0]
    x = np.floor(4_000 * (rng.normal(size=(3_000, 32)) * 0.6 ** np.arange(32)) @ basis).astype(np.int64)
    ids, q = np.arange(len(x)), x[::20]
    plain = topk.search_block(ids[::20], q, ids, x, 20)
    first = topk.search_block(ids[::20], q, ids[:1_000], x[:1_000], 20)
    floor = np.array([s[-1] for _, s in first], float)
    shares: list = []
    turned = topk.search_block(ids[::20], q, ids, x, 20, topk.axes(x[:500].astype(float)), floor, shares)
    products = q @ x.T
    for i, (own, scores) in enumerate(turned):
        wanted = sorted((-int(s), j) for j, s in enumerate(products[i]) if j != 20 * i)[:20]
        assert [(-int(s), int(j)) for s, j in zip(scores, own, strict=True)] == wanted
        assert (plain[i][0] == own).all() and (plain[i][1] == scores).all()
    one, four, sixteen = np.mean(shares, 0)
    assert one > four > sixteen and four < 0.5 and sixteen < 0.1


def test_topk_of_huge_components(spark):
    """Beyond what a long holds: saturated, without an error."""
    rows = [(0, [1e30, 1.0]), (20, [-1e30, 2.0]), (1, [1e300, 1e300]), (2, [3.0, 4.0]), (3, [5e6, 6e6])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in topk.top_k(df, F.col("id") % 20 == 0, 20).collect()}
    assert got[0, 1] == (1 << 63) - 1 and got[20, 1] == -(1 << 63) and len(got) == 8
    assert got[0, 2] == (1 << 63) - 1 and got[20, 3] == -(1 << 63)


def test_chat_with_many_roles_and_turns(spark):
    """100 roles in a ring, loss on every seventh: flags and the first wrong turn by hand, also over 100,000 turns."""
    names = [f"r{i}\u0085" for i in range(100)]
    ring = {"^": (names[0],)} | {r: (names[(i + 1) % 100],) for i, r in enumerate(names)}
    template = chat.Template(loss_roles=tuple(names[::7]), follows=ring)
    rows = [(1, t, names[t % 100], f"t{t}") for t in range(300)] + [(2, t, names[t], "x") for t in range(100) if t != 71] + [(3, 0, "none", "x")]
    long = spark.range(100_000).selectExpr("4L", "id", f"concat('r', id % 100, '{chr(0x85)}')", "concat('t', id)")
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").union(long)
    got = {r["conv_id"]: r for r in chat.format_conversations(df, template).select("conv_id", "n_turns", "first_wrong", "segments.text", "segments.loss").collect()}
    assert [got[i]["first_wrong"] for i in (1, 2, 3, 4)] == [None, 71, 0, None] and got[4]["n_turns"] == 100_000
    for i, n in ((1, 300), (4, 100_000)):
        assert [t for t, on in zip(got[i]["text"], got[i]["loss"]) if on] == [f"t{t}" for t in range(n) if t % 100 % 7 == 0]
