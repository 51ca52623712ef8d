"""Knowledge graphs and the entity index: cases worked by hand from the specified order of processing."""

import pytest

from lexweave.operators import graph as G
from lexweave.operators import knowledge as K

CHUNKS = "doc_id string, position int, chunk_id string, text string, doc_title string, section_number string, section_title string, summary string, cross_refs array<string>"


@pytest.fixture(scope="module")
def graph(spark):
    rows = [
        ("JERG-2-100", 1, "a", "JAXA のISO 9001-2 と JERG-0-051 による。「熱制御」とは、温度を保つことをいう。", "General", "3.1", "Heat", "about heat", ["JERG-0-051", "nowhere"]),
        ("JERG-2-100", 2, "b", "JERG-2-100 and ISO 9001-2", None, "3.1.1", None, None, ["JERG-2-100"]),
        ("JERG-0-051", 3, "c", None, None, "3.1", "Heat again", "not written", None),
        ("JERG-0-051", 4, "d", "「熱制御」とは、熱を逃がすことである。", "Thermal", "", "", "", []),
    ]
    nodes, edges = K.document_graph(spark.createDataFrame(rows, CHUNKS))
    props = {r["node"]: (r["type"], {k: v for k, v in r["properties"].asDict().items() if v is not None}) for r in nodes.collect()}
    return props, sorted((r["from"], r["to"], r["type"]) for r in edges.collect()), nodes, edges


def test_graph_nodes(graph):
    props = graph[0]
    assert props["JERG-2-100"] == ("Document", {"title": "General"})
    # a document that a later text names as a regulation is written over, as the last write wins
    assert props["JERG-0-051"] == ("Concept", {"description": "", "ctype": "regulation"})
    # the number 3.1 is taken when the second document comes
    assert props["JERG-2-100#3.1"] == ("Section", {"doc_id": "JERG-2-100", "section_id": "3.1", "title": "Heat", "level": 2, "summary": "about heat"})
    assert props["JERG-2-100#3.1.1"][1] == {"doc_id": "JERG-2-100", "section_id": "3.1.1", "title": "", "level": 3, "summary": ""}
    assert "JERG-0-051#3.1" not in props
    assert props["ISO 9001-2"][1]["ctype"] == "regulation" and props["ISO 9001"][1]["ctype"] == "organization"
    assert props["熱制御"] == ("Concept", {"description": "は、熱を逃がすこと", "ctype": "concept"})
    assert len(props) == 8


def test_graph_edges(graph):
    edges = graph[1]
    assert edges == sorted(
        [
            ("JERG-2-100", "JERG-2-100#3.1", "CONTAINS"),
            ("JERG-2-100", "JERG-2-100#3.1.1", "CONTAINS"),
            ("JERG-2-100", "ISO 9001-2", "REFERENCES"),
            ("JERG-2-100", "ISO 9001-2", "REFERENCES"),
            ("JERG-2-100", "JERG-0-051", "REFERENCES"),
            ("JERG-2-100", "JERG-0-051", "REFERENCES"),
            ("JERG-2-100", "JAXA", "MENTIONS"),
            ("JERG-2-100", "ISO 9001", "MENTIONS"),
            ("JERG-2-100", "ISO 9001", "MENTIONS"),
            ("JERG-2-100", "熱制御", "DEFINES"),
            ("JERG-0-051", "熱制御", "DEFINES"),
        ]
    )


def test_hubs_of_the_demonstration(spark):
    """The small graph of standards: what heat control leads to within two steps, and who is referred to most."""
    e = [("JERG-2-100", "JERG-2-100#3.1", "CONTAINS"), ("JERG-2-100", "JERG-2-100#3.1.1", "CONTAINS"), ("JERG-2-100", "JERG-0-051", "REFERENCES"), ("JERG-2-100", "熱制御", "DEFINES"), ("熱制御", "DTR", "RELATED_TO"), ("熱制御", "TMM", "RELATED_TO")]
    edges = spark.createDataFrame(e, "`from` string, `to` string, type string")
    found = G.paths(edges, spark.createDataFrame([("熱制御",)], "node string"), 2)
    assert {(r["node"], r["distance"], r["path"]) for r in found.collect()} == {("DTR", 1, "RELATED_TO"), ("TMM", 1, "RELATED_TO"), ("JERG-2-100", 1, "<-DEFINES"), ("JERG-2-100#3.1", 2, "<-DEFINES CONTAINS"), ("JERG-2-100#3.1.1", 2, "<-DEFINES CONTAINS"), ("JERG-0-051", 2, "<-DEFINES REFERENCES")}
    assert {r["in_degree"] for r in G.hubs(edges, 6).collect()} == {1}


def test_cypher_quotes_as_json(spark):
    nodes = spark.createDataFrame([('a\\"', "Concept", ("x\ny", 2, None))], "node string, type string, properties struct<title:string,level:int,summary:string>")
    edges = spark.createDataFrame([("a\\", "熱", "REFERENCES")], "`from` string, `to` string, type string")
    assert [r[0] for r in K.cypher(nodes, edges).collect()] == [r'MERGE (n:Concept {title: "x\ny", level: 2, node_id: "a\\\""})', r'MATCH (a {node_id: "a\\"}), (b {node_id: "熱"}) MERGE (a)-[:REFERENCES]->(b)']


@pytest.fixture(scope="module")
def index(spark):
    text = "1.2 Heat control of all\nISO 1, ISO 2 and ISO 3, JIS A"
    rows = [("c1", 1, text), ("c2", 2, "iso 1; ISO 1, MIL-9, ISO 4, ISO 5, ISO 6"), ("c3", 3, "  \n"), ("c4", 4, None)]
    chunks = spark.createDataFrame(rows, "chunk_id string, position int, text string")
    pairs = [("ISO 1", f"iso {n}") for n in (2, 3, 4, 5, 6)] + [("ISO 2", "ISO 1"), ("ISO 2", "ISO 3"), ("ISO 1", "nobody")]
    return K.entity_index(chunks, spark.createDataFrame(pairs, "source string, target string"))


def test_index(index):
    rows = {r["name"]: r for r in index.entities.collect()}
    assert set(rows) == {"1.2 Heat control of all", *(f"ISO {n}" for n in range(1, 7)), "JIS A", "MIL-9"}
    assert rows["ISO 1"]["mentions"] == 2 and rows["ISO 1"]["type"] == "STANDARD"


def test_rollup_and_search(spark, index):
    rolled = {r["community"]: r for r in K.community_rollup(index).collect()}
    assert all(r["summary"].startswith(K.COMMUNITY_OPENING) for r in rolled.values())
    assert sum(r["n"] for r in rolled.values()) == index.entities.count()
    # six connected entities are more than five: the half with more neighbours, then the others
    halves = sorted((r["n"], r["summary"], r["keywords"], len(r["entity_ids"])) for r in rolled.values() if r["n"] > 1)
    assert halves == [(3, K.COMMUNITY_OPENING + "ISO 1, ISO 2, ISO 3", ["ISO 1", "ISO 2", "ISO 3"], 3), (3, K.COMMUNITY_OPENING + "ISO 4, ISO 5, ISO 6", ["ISO 4", "ISO 5", "ISO 6"], 3)]
    asked = spark.createDataFrame([(1, "iso"), (2, "HEAT of"), (3, " "), (4, "規格文書"), (5, "nothing there")], "query_id int, text string")
    best, near, held = K.local_search(asked, index, k=3)
    got = [(r["query_id"], r["rank"], r["name"], r["score"]) for r in best.orderBy("query_id", "rank").collect()]
    assert got[:3] == [(1, 1, "ISO 1", 3.5), (1, 2, "ISO 2", 3.5), (1, 3, got[2][2], 3.5)]
    # both words are in the name, the whole question isn't
    assert got[3] == (2, 1, "1.2 Heat control of all", 1.0)
    # in the descriptions of standards only
    assert [(q, s) for q, _, _, s in got[4:]] == [(4, 1.0)] * 3
    assert {(r["query_id"], r["chunk_id"]) for r in held.collect()} >= {(1, "c1"), (1, "c2"), (2, "c1")}
    names = [r["name"] for r in near.filter("query_id = 1").collect()]
    assert "ISO 2" in names and len(names) == len(set(names)) <= 10
    assert near.filter("query_id = 2").count() == 0
