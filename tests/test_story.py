"""Arcs and story graphs against plain merging of small lists."""

from pyspark.sql import functions as F

from cairnlight.operators import story as Y

SCHEMA = "pos long, name string, status string, evidence_count int, missing_link string, next_move string, concepts array<struct<name:string,appearances:int>>, papers array<struct<doi:string,title:string>>, arc string"
ROWS = [
    (3, "Ionic GATE two", "rising", 2, " ", "move 3", [("x", 4), ("y", None)], [("D1", "a"), (None, "Title")], "clash"),
    (1, "ionic one", "active", 3, "", None, [("x", 9), (" ", 3), ("z", 9)], [("d1", "b"), ("", ""), ("", "title ")], "clash"),
    (2, "gate and motor", "rising", None, "gap 2", "", None, None, None),
    (4, "nothing", "rising", 50, "gap", "m", [("q", 99)], [("q", "q")], None),
    (5, None, None, None, None, None, [], [], None),
    *[(10 + i, f"motor {i}", "seed", 1, "", "", [(f"c{i}", i)], [(f"p{i}", "")], None) for i in range(20)],
]
TERMS = {"a": ("ionic", "gate"), "m": ("motor",), "none": ("zzz",)}


def test_arcs_merge_their_trajectories(spark):
    got = {r.arc: r for r in Y.arcs(spark.createDataFrame(ROWS, SCHEMA), TERMS).collect()}
    assert set(got) == {"a", "m"}
    a, m = got["a"], got["m"]
    assert (a.status, a.missing_link, a.next_move, a.related) == ("rising", "gap 2", "move 3", ["ionic one", "gate and motor", "Ionic GATE two"])
    assert [(c.name, c.appearances) for c in a.concepts] == [("z", 9), ("x", 9), ("y", 0)] and a.concept_count == 3
    assert [(p.doi, p.title) for p in a.papers] == [("d1", "b"), ("", "title ")] and a.paper_count == 2
    assert a.evidence_count == max(3 + 2, 2 + 18)
    assert len(m.concepts) == 5 and m.concepts[0].name == "c19" and len(m.papers) == 8 and m.papers[0].doi == "p0" and m.paper_count == 20 and len(m.related) == 4
    assert m.evidence_count == max(20, 20 + 19 + 18 + 17 + 16 + 15)
    assert Y.arcs(spark.createDataFrame([], SCHEMA), TERMS).collect() == []


def test_story_nodes_and_edges(spark):
    arcs = Y.arcs(spark.createDataFrame(ROWS, SCHEMA), TERMS)
    titles = {t: F.lit(t) for _, t, _, _ in Y.NODES}
    nodes = sorted((r for r in Y.nodes(arcs, titles).collect() if r.arc == "a"), key=lambda r: r.place)
    assert [n.node_type for n in nodes] == [t for _, t, _, _ in Y.NODES] and [n.status for n in nodes] == ["active", "watching", "rising", "seed", "active", "rising"]
    assert nodes[0].summary == "20 evidence points, 2 supporting papers and 3 related concept signals currently support this node." and nodes[5].summary == "gap 2"
    assert nodes[3].missing_link == "" and len(nodes[3].papers) == 2
    edges = [(e.source, e.target, e.type) for e in Y.edges(arcs).collect() if e.arc == "a"]
    assert edges == [(a[0], b[0], "evolves_to") for a, b in zip(Y.NODES, Y.NODES[1:])]
    bare = Y.arcs(spark.createDataFrame([(1, "motor", "seed", 1, "", "", None, None, None)], SCHEMA), TERMS)
    one = {n.node_type: n for n in Y.nodes(bare, titles).collect()}
    assert one["turning_point"].status == "watching" and one["question"].summary.startswith("1 evidence point, 0 supporting papers")
