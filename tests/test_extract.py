"""The extract in both modes on a small map, from XML and from tables."""

import xml.etree.ElementTree as ET
from pathlib import Path

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

from geosift.operators import closure, extract, idset
from geosift.operators import polygon as P
from geosift.schema import NODE, RELATION, WAY, Elements
from geosift.sources import osm_xml, sinks

AREA = [P.include((0, 0), (5, 0), (10, 5))]
# Places and ids of nodes 1 to 5, the references of ways 1 and 2 and the members of relations 1 to 4, which decide the
# counts asserted below. Added cases: tags with escapes, node -6, reference 99, way 3, relations 5 and 6, the member of type area.
MAP = """<?xml version="1.0" encoding="UTF-8"?>
<osm version="0.6" generator="hand">
  <bounds minlat="0" minlon="0" maxlat="1" maxlon="1"/>
  <node id="1" lat="0" lon="0" version="3" timestamp="2010-01-01T00:00:00Z" user="a &amp; b" uid="7" changeset="9" visible="true"/>
  <node id="2" lat="0" lon="5.0"/>
  <node id="3" lat="5.0" lon="10"><tag k="name" v="&lt;x&gt; &quot;y&quot;"/><tag k="name" v="twice"/></node>
  <node id="4" lat="10" lon="10"/><node id="5" lat="10" lon="0"/><node id="-6" lat="15" lon="15"/>
  <way id="1"><nd ref="1"/><nd ref="2"/><nd ref="3"/><nd ref="4"/><nd ref="99"/><nd ref="1"/><tag k="highway" v="service"/></way>
  <way id="2"><nd ref="4"/></way><way id="3"/>
  <relation id="1"><member type="way" ref="1" role=""/><member type="node" ref="-6" role="x"/><tag k="type" v="a"/></relation>
  <relation id="2"><member type="node" ref="4" role=""/></relation>
  <relation id="3"><member type="way" ref="2" role=""/></relation>
  <relation id="4"><member type="relation" ref="2" role=""/><member type="relation" ref="3" role=""/><member type="area" ref="1" role=""/></relation>
  <relation id="5"><member type="relation" ref="6" role=""/></relation>
  <relation id="6"><member type="relation" ref="5" role=""/><member type="relation" ref="1" role="sub"/></relation>
</osm>
"""


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    f = tmp_path_factory.mktemp("map") / "map.osm"
    f.write_text(MAP)
    return str(f)


def ids(df):
    return sorted(r.id for r in df.collect())


def members(df):
    return {r.id: [(m.type, m.ref, m.role) for m in r.members] for r in df.collect()}


def test_reading(spark, path):
    m = osm_xml.read_osm_xml(spark, path)
    nodes = {r.id: r for r in m.nodes.collect()}
    assert (nodes[1].x, nodes[1].y, nodes[1].version, nodes[1].timestamp, nodes[1].user) == (0.0, 0.0, 3, "2010-01-01T00:00:00Z", "a & b")
    assert [(t.k, t.v) for t in nodes[3].tags] == [("name", '<x> "y"'), ("name", "twice")] and nodes[2].tags == []
    assert {r.id: r.nodes for r in m.ways.collect()} == {1: [1, 2, 3, 4, 99, 1], 2: [4], 3: []}
    assert members(m.relations)[1] == [("way", 1, ""), ("node", -6, "x")]
    assert m.root == {"version": "0.6", "generator": "hand"}


def test_complete(spark, path):
    out = extract.cut(osm_xml.read_osm_xml(spark, path), AREA)
    assert ids(out.nodes) == [1, 2, 3, 4]
    assert {r.id: r.nodes for r in out.ways.collect()} == {1: [1, 2, 3, 4, 99, 1]}
    assert members(out.relations) == {1: [("way", 1, "")], 2: [("node", 4, "")], 4: [("relation", 2, "")], 5: [("relation", 6, "")],
                                      6: [("relation", 5, ""), ("relation", 1, "sub")]}


def test_simple_follows_only_earlier_relations(spark, path):
    out = extract.cut(osm_xml.read_osm_xml(spark, path), AREA, mode="simple")
    assert ids(out.nodes) == [1, 2, 3]
    assert {r.id: r.nodes for r in out.ways.collect()} == {1: [1, 2, 3, 1]}
    assert members(out.relations) == {1: [("way", 1, "")], 6: [("relation", 1, "sub")]}
    with pytest.raises(ValueError):
        extract.cut(out, AREA, mode="other")


def test_round_trip(spark, path, tmp_path):
    m = osm_xml.read_osm_xml(spark, path)
    out = str(tmp_path / "out")
    sinks.write_osm(m, out)
    again = osm_xml.read_osm_xml(spark, out)
    for a, b in ((m.nodes, again.nodes), (m.ways, again.ways), (m.relations.drop("pos"), again.relations.drop("pos"))):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert again.root == m.root


def same_map(a, b):
    for x, y in ((a.nodes, b.nodes), (a.ways, b.ways), (a.relations.drop("pos"), b.relations.drop("pos"))):
        assert sorted(map(str, x.collect())) == sorted(map(str, y.collect()))
    assert a.root == b.root


def test_parts_are_documents(spark, tmp_path):
    nodes = spark.range(4000).selectExpr("id", "id / 8 x", "id / 4 y", "1L version", "'2010' timestamp", "2L uid", "'a > \"b\"' user", "3L changeset", "array(struct('k' k, '<>' v)) tags")
    ways = spark.range(500).selectExpr("id", "sequence(id, id + 5) nodes", "1L version", "'2010' timestamp", "2L uid", "\"it's\" user", "3L changeset",
                                       "cast(array() as array<struct<k:string,v:string>>) tags")
    m = Elements(nodes, ways, spark.createDataFrame([], RELATION), {"version": "0.6"})
    out, one = str(tmp_path / "many"), str(tmp_path / "one")
    spark.conf.set("spark.sql.shuffle.partitions", "10")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_osm(m, out)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sinks.write_osm(m, one, files=1)
    files = sorted(Path(out).glob("part-*"))
    assert len(files) >= 8 and len(list(Path(one).glob("part-*"))) == 1
    ids_ = [int(e.get("id")) for f in files for e in ET.parse(f).getroot().iter("node")]  # each file is well-formed
    assert ids_ == list(range(4000))
    same_map(osm_xml.read_osm_xml(spark, out), m)
    same_map(osm_xml.read_osm_xml(spark, one), m)
    assert osm_xml.read_osm_xml(spark, str(files[3])).nodes.count() < 4000


TRICKY = MAP.replace('  <way id="2">', '  <!-- <node id="777"/> > - ' + " ".join(f'<node id="{900 + k}"/>' for k in range(30)) + " -->\n  <way id=\"2\">").replace(
    'user="a &amp; b"', "user='a > \" --' ")


@pytest.mark.parametrize("size", [40, 333])
def test_splits_cut_anywhere(spark, tmp_path, size):
    """Elements, attributes' values and comments that splits cut are read as a whole."""
    f = tmp_path / "t.osm"
    f.write_text(TRICKY)
    whole = ET.fromstring(TRICKY)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        m = osm_xml.read_osm_xml(spark, str(f))
        assert spark.read.text(str(f), lineSep=">").rdd.getNumPartitions() > len(TRICKY) // size // 2
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(r.id for r in m.nodes.collect()) == sorted(int(e.get("id")) for e in whole.iter("node"))
    assert {r.user for r in m.nodes.where("id = 1").collect()} == {'a > " --'}
    assert {r.id: r.nodes for r in m.ways.collect()} == {int(w.get("id")): [int(n.get("ref")) for n in w.iter("nd")] for w in whole.iter("way")}
    assert [r.id for r in m.relations.orderBy("pos").collect()] == [int(r.get("id")) for r in whole.iter("relation")]
    assert members(m.relations) == {int(r.get("id")): [(e.get("type"), int(e.get("ref")), e.get("role")) for e in r.iter("member")] for r in whole.iter("relation")}
    assert m.root == dict(whole.attrib)


def test_malformed_maps(spark, tmp_path):
    for k, text in enumerate(("<osm><way id='1'><nd ref='1'/>", "<osm><way id='1'><node id='2'/></way></osm>", "<osm><node id='x'/></osm>")):
        f = tmp_path / f"{k}.osm"
        f.write_text(text)
        with pytest.raises((PySparkException, Py4JJavaError)):
            m = osm_xml.read_osm_xml(spark, str(f))
            m.nodes.collect(), m.ways.collect()


def test_empty_maps(spark):
    empty = Elements(spark.createDataFrame([], NODE), spark.createDataFrame([], WAY), spark.createDataFrame([], RELATION), {})
    for mode in ("complete", "simple"):
        out = extract.cut(empty, AREA, mode)
        assert out.nodes.count() == out.ways.count() == out.relations.count() == 0


def test_many_elements_lose_none(spark):
    nodes = spark.range(5000).selectExpr("id", "1.0D x", "0.5D y")
    ways = spark.createDataFrame([], WAY)
    m = Elements(nodes, ways, spark.createDataFrame([], RELATION), {})
    assert extract.cut(m, AREA).nodes.count() == 5000


def test_closures(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 6), (None, 1)], "child long, parent long")
    seeds = spark.createDataFrame([(1,), (5,)], "id long")
    assert ids(closure.ancestors(seeds, links)) == [1, 2, 3, 4, 5, 6]
    assert ids(closure.ancestors(closure.ancestors(seeds, links), links)) == [1, 2, 3, 4, 5, 6]
    assert ids(closure.find_cycles(links)) == [1, 2, 3]
    assert closure.find_cycles(links.limit(0)).count() == 0
    assert (5, 6) in {(r.child, r.ancestor) for r in closure.type_ancestors(links).collect()}


def test_id_sets(spark):
    a = spark.createDataFrame([(-5,), (0,), (1,), (40000,), (None,)], "id long")
    b = spark.createDataFrame([(1,), (2,)], "id long")
    assert ids(idset.bitmap_members(spark.createDataFrame([(-5,), (-6,), (1,), (40000,), (2,)], "id long"), idset.bitmap(a))) == [-5, 1, 40000]
    bits = idset.bitmap_union(idset.bitmap(a), idset.bitmap(b))
    assert sum(r.n for r in idset.bitmap_counts(bits).collect()) == 5
    assert ids(idset.union(idset.id_set(a, "id"), b)) == [-5, 0, 1, 2, 40000]


def poly(spark, text):
    return osm_xml.parse_poly(spark.createDataFrame([("f", text)], "path string, value string")).orderBy("poly_id").collect()


def test_polygon_files(spark, tmp_path):
    rows = poly(spark, "name\n1\n\t0 0\n 5.0 0\r\n 1E1 .5\nEND\n!2\n 1 1\n 2 1\n 2 2\nEND\nEND\nignored 3\n")
    assert [(r.poly_id, r.kind, [(p.x, p.y) for p in r.ring]) for r in rows] == [
        (0, "include", [(0, 0), (5, 0), (10, 0.5)]), (1, "exclude", [(1, 1), (2, 1), (2, 2)])]
    f = tmp_path / "a.poly"
    f.write_text("n\n1\n 0 0\n 5 0\n 10 5\nEND\nEND\n")
    assert P.polygons_of(osm_xml.read_poly(spark, str(f))) == AREA
    for bad in ("n\nname\n 0 0\nEND\nEND\n", "n\n1\n 0 x\nEND\nEND\n", "n\n1\nEND\nEND\n", "n\n1\n 0 0\n"):
        with pytest.raises(PySparkException):
            poly(spark, bad)


def test_whole_elements_are_read_by_columns(monkeypatch):
    import pyarrow as pa

    calls = []
    take = osm_xml._Split.take
    monkeypatch.setattr(osm_xml._Split, "take", lambda self, text: (calls.append(text), take(self, text))[1])
    ways = [f'<way id="{i}">\n<nd ref="{i}"/>\n<tag k="n" v="o\'{i}"/>\n</way>' for i in range(500)]
    values = ('<?xml version="1.0"?><osm><node id="7"/>' + "\n".join(ways) + '<node id="8"/><!-- <node id="9"/> --></osm>\n').split(">")
    batches = [pa.RecordBatch.from_pydict({"path": ["f"] * len(v), "block": [0] * len(v), "value": v}) for v in (values[a : a + 300] for a in range(0, len(values), 300))]
    rows = [r for b in osm_xml._assemble(iter(batches)) for r in b.to_pylist()]
    assert [r["tag"] for r in rows] == ["osm", "node", *["way"] * 500, "node", "end"]
    assert [r["seq"] for r in rows] == list(range(len(rows)))
    assert [r["xml"] for r in rows[2:502]] == [w.replace("\n", "") for w in ways]
    assert len(calls) < len(values) / 2  # the first and the last batch, and what batches cut


def test_a_map_is_parsed_once(spark, path):
    m = osm_xml.read_osm_xml(spark, path)
    for part in (m.nodes, m.ways, m.relations):
        assert "from_xml" not in part._jdf.queryExecution().toString()
