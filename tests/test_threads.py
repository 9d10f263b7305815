"""Tree operators: children, leaves, chains, rejects and prompts on hand-made fixtures."""

from pyspark.sql import functions as F

from threadspark.operators import prompts as L
from threadspark.operators import threads as T
from threadspark.schemas import CONTENT_SCHEMA


def _units(spark, rows):
    full = []
    for r in rows:
        d = dict(url="u", source_text=None, subreddit="S", author_tag="", tag=None, user=None, text="<p>x</p>",
                 date="d", upvotes=None, id=None, parent_id=None, is_post=False, title=None)
        d.update(r)
        full.append(tuple(d[f.name] for f in CONTENT_SCHEMA.fields))
    return spark.createDataFrame(full, CONTENT_SCHEMA)


F1 = [
    dict(id="p1", parent_id=None, is_post=True, user="ann", title="T", text="<p>root</p>"),
    dict(id="c1", parent_id="p1", user="bob", text="<p>one</p>"),
    dict(id="c2", parent_id="c1", user="cat", text="<p>two</p>"),
    dict(id="c3", parent_id="c1", user="dan", text="<p>three</p>"),
    dict(id="c4", parent_id="p1", user="eve", text="<p>four</p>"),
]


def test_chains_f1(spark):
    u = _units(spark, F1)
    ct = T.chain_table(u, with_children_ids=True)
    got = sorted((r.chain_id, r.chain_rank, r.id, r.child_count, tuple(r.children_ids)) for r in ct.collect())
    assert got == sorted([
        ("c2", 0, "p1", 2, ("c1", "c4")), ("c2", 1, "c1", 2, ("c2", "c3")), ("c2", 2, "c2", 0, ()),
        ("c3", 0, "p1", 2, ("c1", "c4")), ("c3", 1, "c1", 2, ("c2", "c3")), ("c3", 2, "c3", 0, ()),
        ("c4", 0, "p1", 2, ("c1", "c4")), ("c4", 1, "c4", 0, ()),
    ])
    assert sorted(r.id for r in T.leaves(u).collect()) == ["c2", "c3", "c4"]


def test_edge_rows_f2(spark):
    rows = F1 + [
        dict(id="lone", is_post=True, title="L"),            # post without replies: its own chain
        dict(id="orph", parent_id="missing"),                # orphan comment
        dict(id="x1", parent_id="x2"), dict(id="x2", parent_id="x1"),  # two-node cycle
        dict(id="c4", parent_id="p1", user="zed"),           # duplicate id
    ]
    u = T.dedupe_units(_units(spark, rows))
    assert u.count() == 9
    members = T.chain_members(u)
    chains = {r.chain_id: r.n for r in members.groupBy("chain_id").agg(F.count("*").alias("n")).collect()}
    assert chains == {"c2": 3, "c3": 3, "c4": 2, "lone": 1}
    assert sorted(r.id for r in T.rejects(u).collect()) == ["orph", "x1", "x2"]


def test_chain_properties_forest(spark):
    from threadspark.plans import views as V

    u = V.forest(spark, "/root/testdata/sf0.001")
    m = T.chain_members(u).cache()
    n_leaves = T.leaves(u).count()
    assert m.select("chain_id").distinct().count() == n_leaves
    roots = m.where("chain_rank = 0").join(u.select("id", "is_post"), "id")
    assert roots.where(~F.col("is_post")).count() == 0
    gaps = m.groupBy("chain_id").agg((F.max("chain_rank") + 1 - F.count("*")).alias("g")).where("g != 0")
    assert gaps.count() == 0


def test_prompt_f3(spark):
    u = _units(spark, F1)
    p = {(r.chain_id, r.id): r.prompt for r in L.chain_prompts(u).collect()}
    assert p[("c2", "c1")] == "Post by ann, title: T, initial comment: root\nhide \nResponded to by bob, comment: one\nhide \n"
    # prefix property: the prompt of rank k+1 starts with the prompt of rank k
    assert p[("c2", "c2")].startswith(p[("c2", "c1")])
    assert p[("c2", "p1")] == "Post by ann, title: T, initial comment: root\nhide \n"


def test_template_and_answers(spark):
    u = _units(spark, F1)
    t = L.apply_template(L.chain_prompts(u), "TASK").collect()
    assert all(r.model_input.startswith("TASK \n Post by ann") for r in t)
    df = spark.createDataFrame([("c", "i", "x\nA1: 0.5\nA2: 1\nA3: n/a")], "chain_id string, id string, output string")
    r = L.parse_answers(df, n=3).first()
    assert (r.a1, r.a2, r.a3) == (0.5, 1.0, None)


def test_deep_chain_takes_logarithmic_rounds(spark, monkeypatch):
    """1,000 replies in a line beside bushes, an orphaned line and a cycle."""
    n = 1000
    rows = [("d0", None, True)] + [(f"d{k}", f"d{k - 1}", False) for k in range(1, n + 1)]
    rows += [("b", None, True)] + [(f"b{k}", "b" if k < 5 else f"b{k - 5}", False) for k in range(40)]
    rows += [(f"o{k}", "gone" if k == 0 else f"o{k - 1}", False) for k in range(60)]
    rows += [(f"y{k}", f"y{(k + 1) % 7}", False) for k in range(7)]
    units = spark.createDataFrame(rows, "id string, parent_id string, is_post boolean")
    written = []
    monkeypatch.setattr(T, "materialize", lambda df: written.append(1) or df.checkpoint())
    r = T.reach(units, F.array("id"))
    nodes = {x.id: x for x in r.nodes.collect()}
    assert len(written) <= 12 + 1  # log2(1000) + 2 rounds and the units themselves
    assert set(nodes) == {i for i, _, _ in rows if i[0] in "db"}
    assert nodes["d1000"].depth == n and nodes["d1000"].value == [f"d{k}" for k in range(n + 1)] and nodes["d1000"].root == "d0"
    assert nodes["b39"].depth == 8 and nodes["b39"].value == ["b", "b4", "b9", "b14", "b19", "b24", "b29", "b34", "b39"]
    chains = {}
    for m in T.chain_members(units, r).where("chain_id IN ('d1000', 'b37')").collect():
        chains.setdefault(m.chain_id, {})[m.chain_rank] = m.id
    assert chains["d1000"] == {k: f"d{k}" for k in range(n + 1)}
    assert chains["b37"] == dict(enumerate(["b", "b2", "b7", "b12", "b17", "b22", "b27", "b32", "b37"]))
    assert {x.id for x in T.rejects(units, r).collect()} == {i for i, _, _ in rows if i[0] in "oy"}


def test_reach_of_few_units(spark):
    schema = "id string, parent_id string, is_post boolean"
    assert T.chain_members(spark.createDataFrame([], schema)).collect() == []
    only = spark.createDataFrame([("a", None, True), ("b", "z", True), ("c", None, False), ("e", "a", None)], schema)
    assert sorted((r.chain_id, r.chain_rank, r.id) for r in T.chain_members(only).collect()) == [("b", 0, "b")]
    assert sorted((r.id, r.root, r.depth) for r in T.reach(only).nodes.collect()) == [("a", "a", 0), ("b", "b", 0)]


def test_prompts_look_up_no_ancestor_text(spark):
    """Prompts grow along the pointers: the plan of the reach holds no explode and no grouping of lines."""
    plan = L.unit_prompts(_units(spark, F1))._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "explode" not in plan.lower()


def test_reach_looks_up_no_leaf(spark):
    """with leaves marked, paths, depths and jump tables are the same."""
    rows = [("p", None, True), ("a", "p", False), ("b", "a", False), ("c", "b", False), ("c", "b", False), ("d", "c", False), ("q", None, True), ("x", "gone", False)]
    units = spark.createDataFrame(rows, "id string, parent_id string, is_post boolean")
    plain, marked = T.reach(units, F.array("id")), T.reach(T.with_leaf(units), F.array("id"), leaf="_leaf")
    key = ["id", "root", "depth", "value"]
    assert sorted(map(tuple, plain.nodes.select(key).collect())) == sorted(map(tuple, marked.nodes.select(key).collect()))
    assert {r.id for r in marked.nodes.where("_leaf").collect()} == {"d", "q"}
    assert [sorted(map(tuple, j.collect())) for j in plain.jumps] == [sorted(map(tuple, j.collect())) for j in marked.jumps]


def test_leaf_text_stays_out_of_the_rounds(spark, monkeypatch):
    """rounds carry no leaf's line, a leaf's prompt meets its chain without a shuffle; repeated ids give the rows they gave."""
    rows = [("p", None, True), ("a", "p", False), ("b", "a", False), ("c", "b", False), ("c", "b", False), ("d", "p", False), ("q", None, True), ("x", "gone", False)]
    rows += [("q", "b", False)]  # an id that is a post and a reply
    units = spark.createDataFrame([(i, p, post, f"u{i}", None, f"<p>{i}</p>") for i, p, post in rows], "id string, parent_id string, is_post boolean, user string, title string, text string")
    written = []
    monkeypatch.setattr(T, "stored", lambda df: written.append(df.checkpoint()) or written[-1])
    reached = L.reach_prompts(units)
    assert len(written) > 1 and all(r.value is None for w in written[1:] for r in w.where("_leaf").collect())
    members = T.chain_members(units, reached)
    want = members.join(L.unit_prompts(units, reached), "id").select("chain_id", "id", "chain_rank", "prompt")
    assert sorted(map(tuple, want.collect())) == sorted(map(tuple, L.chain_prompts(units).collect())) and want.where("id = 'c'").count() > 2
    monkeypatch.setattr(L, "REPEATED_ROWS", 0)
    assert sorted(map(tuple, want.collect())) == sorted(map(tuple, L.chain_prompts(units).collect()))
