"""Schemas, typed scans and writes, events, scalar functions."""

import itertools
import os
import random
import re
import time

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from geosift.functions import text as X
from geosift.functions import xml as XML
from geosift.plans import queries, xsd, xsd_rules

HEAD = '<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema" xmlns="urn:t" targetNamespace="urn:t">'
SEQ = '<xs:sequence><xs:element name="a" type="xs:string"/><xs:element name="b" type="xs:string" maxOccurs="3"/></xs:sequence>'
ROOTS = {
    "sequence": f'<xs:element name="root"><xs:complexType>{SEQ}</xs:complexType></xs:element>',
    "named": f'<xs:complexType name="T">{SEQ}</xs:complexType><xs:element name="root" type="T"/>',
    "reference": '<xs:element name="a" type="xs:string"/><xs:element name="root"><xs:complexType><xs:sequence><xs:element ref="a"/>'
                 '<xs:element name="b" type="xs:string" maxOccurs="unbounded"/></xs:sequence></xs:complexType></xs:element>',
    "group": f'<xs:group name="G">{SEQ}</xs:group><xs:element name="root"><xs:complexType><xs:group ref="G"/></xs:complexType></xs:element>',
    "simple": '<xs:simpleType name="S"><xs:restriction base="xs:string"/></xs:simpleType><xs:element name="root"><xs:complexType><xs:sequence>'
              '<xs:element name="a" type="S"/><xs:element name="b" type="S" maxOccurs="3"/></xs:sequence></xs:complexType></xs:element>',
    "extension": '<xs:complexType name="B"><xs:sequence><xs:element name="a" type="xs:string"/></xs:sequence></xs:complexType>'
                 '<xs:complexType name="D"><xs:complexContent><xs:extension base="B"><xs:sequence><xs:element name="b" type="xs:string" maxOccurs="3"/>'
                 '</xs:sequence></xs:extension></xs:complexContent></xs:complexType><xs:element name="root" type="D"/>',
}


def docs(spark, *xml):
    return spark.createDataFrame([(i, x) for i, x in enumerate(xml)], "id long, xml string")


@pytest.mark.parametrize("kind", ROOTS)
def test_one_document_many_schemas(spark, kind):
    model = xsd.compile_xsd(f"{HEAD}{ROOTS[kind]}</xs:schema>")
    row = xsd.scan(docs(spark, "<root><a>123</a><b>value 1</b><b>value 2</b></root>"), model, "root").first()
    assert (row.value.a, row.value.b, row.fault) == ("123", ["value 1", "value 2"], None)


def test_types_attributes_choices_and_faults(spark):
    model = xsd.compile_xsd(f"""{HEAD}<xs:attributeGroup name="AG"><xs:attribute name="w" type="xs:boolean"/></xs:attributeGroup>
      <xs:element name="r"><xs:complexType><xs:sequence><xs:element name="n" type="xs:int"/><xs:choice><xs:element name="p" type="xs:string"/>
      <xs:element name="q" type="xs:integer"/></xs:choice><xs:element name="m" type="xs:string" minOccurs="0" maxOccurs="2"/></xs:sequence>
      <xs:attribute name="k" type="xs:string" use="required"/><xs:attributeGroup ref="AG"/></xs:complexType></xs:element></xs:schema>""")
    rows = xsd.scan(docs(spark, '<r k="x" w="true"><n>5</n><q>7</q></r>', "<r><n>5</n><p>t</p></r>", '<r k="x"><n>1</n></r>',
                         '<r k="x"><n>1</n><p>a</p><m>1</m><m>2</m><m>3</m></r>'), model, "r").orderBy("id").collect()
    assert (rows[0].value.n, rows[0].value.q, rows[0].value["_w"], rows[0].fault) == (5, 7, True, None)
    assert [r.fault for r in rows[1:]] == ["missing r/@k", "missing r/p or r/q", "too many r/m"]
    late = xsd.scan(docs(spark, '<r k="x"><n>1</n><p>a</p><q>2</q></r>', '<r k="x" y="z"><n>1</n><p>a</p></r>'), model, "r").orderBy("id").collect()
    assert [r.fault for r in late] == ["wrong content of r: n p q", "unexpected r/@y"]
    with pytest.raises(Exception, match="five"):  # the reader's own error
        xsd.scan(docs(spark, '<r k="x"><n>five</n><p/></r>'), model, "r").collect()
    assert model.ddl("r").startswith("struct<n:bigint")


def test_write_is_the_inverse(spark):
    model = xsd.compile_xsd(f"{HEAD}{ROOTS['sequence']}</xs:schema>")
    rows = xsd.scan(docs(spark, "<root><a>1 &amp; 2</a><b>x</b><b>y</b></root>"), model, "root")
    text = rows.select(xsd.write(rows, model, "root").alias("xml"), "id")
    again = xsd.scan(text, model, "root").first()
    assert (again.value.a, again.value.b) == ("1 & 2", ["x", "y"])
    bad = xsd.scan(docs(spark, "<root><a>1</a></root>"), model, "root")
    with pytest.raises(PySparkException):
        bad.select(xsd.write(bad, model, "root")).collect()


def test_includes_substitution_and_merge():
    parts = {"a.xsd": f'{HEAD}<xs:element name="shape" type="xs:string"/><xs:element name="disc" type="xs:string" substitutionGroup="shape"/></xs:schema>'}
    seen = []
    main = f'{HEAD}<xs:include schemaLocation="a.xsd"/><xs:include schemaLocation="a.xsd"/><xs:element name="r"><xs:complexType><xs:sequence><xs:element ref="shape"/></xs:sequence></xs:complexType></xs:element></xs:schema>'
    model = xsd.compile_xsd(main, lambda ns, where: seen.append(where) or parts[where])
    assert seen == ["a.xsd"] and [f.name for f in model.elements["r"].fields] == ["shape", "disc"]
    other = xsd.compile_xsd(f'{HEAD}<xs:element name="z" type="xs:int"/></xs:schema>')
    assert set(model.merge(other).elements) == {"r", "shape", "disc", "z"}
    with pytest.raises(xsd.SchemaError):
        model.schema("none")
    with pytest.raises(xsd.SchemaError):
        xsd.compile_xsd(f'{HEAD}<xs:attributeGroup name="A"><xs:attributeGroup ref="A"/></xs:attributeGroup><xs:element name="r"><xs:complexType><xs:attributeGroup ref="A"/></xs:complexType></xs:element></xs:schema>')


def faults(rules, texts, element):
    spark = SparkSession.getActiveSession()
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, xml string").coalesce(1)
    return [r.fault for r in rows.select("id", xsd_rules.first_fault(F.col("xml"), rules, element).alias("fault")).orderBy("id").collect()]


def fault(xsd_body, xml, element="r", head=HEAD):
    return faults(xsd.compile_xsd(f"{head}{xsd_body}</xs:schema>").rules, [xml], element)[0]


def test_rules_of_groups(spark):
    body = ('<xs:group name="G"><xs:sequence><xs:element name="a" type="xs:string"/><xs:choice maxOccurs="2"><xs:element name="b" type="xs:string"/><xs:element name="c" type="xs:string"/></xs:choice>'
            '</xs:sequence></xs:group><xs:element name="r"><xs:complexType><xs:sequence><xs:group ref="G" minOccurs="0" maxOccurs="2"/><xs:element name="z" type="xs:string"/></xs:sequence></xs:complexType></xs:element>')
    for good in ("<z/>", "<a/><b/><z/>", "<a/><c/><b/><a/><b/><z/>"):
        assert fault(body, f"<r>{good}</r>") is None
    for bad in ("", "<a/><z/>", "<b/><a/><z/>", "<a/><b/><c/><b/><z/>", "<z/><z/>", "<a/><b/>" * 3 + "<z/>"):
        assert fault(body, f"<r>{bad}</r>").startswith("wrong content of r")
    assert fault(body, "<r><a><x/></a><b/><z/></r>") == "unexpected r/a/x" and fault(body, "<r>") .startswith("not well-formed") and fault(body, None) is None
    all_ = '<xs:element name="r"><xs:complexType><xs:all><xs:element name="a" type="xs:string"/><xs:element name="b" type="xs:string" minOccurs="0"/></xs:all></xs:complexType></xs:element>'
    assert fault(all_, "<r><b/><a/></r>") is None and fault(all_, "<r><b/></r>") == "missing r/a" and fault(all_, "<r><a/><a/></r>") == "too many r/a"
    assert fault(all_, "<r><a/><q/></r>") == "unexpected r/q"


def test_rules_of_wildcards_mixed_and_recursive_types(spark):
    any_ = '<xs:element name="r"><xs:complexType{}><xs:sequence><xs:element name="a" type="xs:string"/><xs:any namespace="{}" maxOccurs="2"/></xs:sequence><xs:anyAttribute namespace="##other"/></xs:complexType></xs:element>'
    for spaces, good, bad in (("##any", '<q/><w:x xmlns:w="urn:w"/>', "<q/>" * 3), ("##other", '<w:x xmlns:w="urn:w"><w:y/></w:x>', "<q/>"), ("##local", "<q/>", '<w:x xmlns:w="urn:w"/>'),
                              ("urn:v ##targetNamespace", '<w:x xmlns:w="urn:v"/><t:x xmlns:t="urn:t"/>', '<w:x xmlns:w="urn:w"/>')):
        assert fault(any_.format("", spaces), f"<r><a/>{good}</r>") is None and fault(any_.format("", spaces), f"<r><a/>{bad}</r>") is not None
    assert fault(any_.format("", "##any"), '<r w:k="1" xmlns:w="urn:w"><a/><q/></r>') is None and fault(any_.format("", "##any"), '<r k="1"><a/><q/></r>') == "unexpected r/@k"
    assert fault(any_.format("", "##any"), "<r>t<a/><q/></r>") == "unexpected text in r" and fault(any_.format(' mixed="true"', "##any"), "<r>t<a/>u<q/>v</r>") is None
    deep = '<xs:complexType name="N"><xs:sequence><xs:element name="c" type="N" minOccurs="0"/></xs:sequence></xs:complexType><xs:element name="r" type="N"/>'
    assert fault(deep, f"<r>{'<c>' * 50}{'</c>' * 50}</r>") is None and fault(deep, f"<r>{'<c>' * 20}<x/>{'</c>' * 20}</r>") == f"unexpected r{'/c' * 20}/x"
    one, two = (xsd.compile_xsd(f'{HEAD}<xs:element name="{n}"><xs:complexType><xs:sequence><xs:element name="{m}" type="xs:int"/></xs:sequence></xs:complexType></xs:element></xs:schema>')
                for n, m in (("p", "a"), ("q", "b")))
    both = one.merge(two).rules
    assert faults(both, ["<p><a/></p>"], "p") == [None] and faults(both, ["<q><b/></q>", "<q><a/></q>"], "q") == [None, "unexpected q/a"]


def test_nested_occurrence_is_linear(spark):
    body = ('<xs:element name="r"><xs:complexType><xs:sequence maxOccurs="unbounded"><xs:sequence minOccurs="0" maxOccurs="unbounded"><xs:element name="a" type="xs:string" minOccurs="0" maxOccurs="unbounded"/>'
            '<xs:element name="b" type="xs:string" minOccurs="0" maxOccurs="3"/></xs:sequence></xs:sequence></xs:complexType></xs:element>')
    rules = xsd.compile_xsd(f"{HEAD}{body}</xs:schema>").rules
    assert faults(rules, ["<r>" + "<a/>" * 14 + "<c/></r>", "<r/>", "<r><b/><a/><b/><b/></r>"], "r") == ["unexpected r/c", None, None]
    began = time.perf_counter()
    assert faults(rules, ["<r>" + "<a/><b/>" * 50_000 + "</r>", "<r>" + "<a/>" * 100_000 + "<c/></r>"], "r") == [None, "unexpected r/c"]
    assert time.perf_counter() - began < 20
    model = rules.kinds[rules.elements["r"][0]].content
    at, began = model, time.perf_counter()
    for _ in range(100_000):
        at = xsd_rules.after(at, "}a")
    assert xsd_rules.may_end(at) and time.perf_counter() - began < 1


def test_content_models_equal_regular_expressions():
    """Automata against Python's matching, on short words of nested groups and counters."""
    rng = random.Random(3)

    def model(depth):
        if depth == 0 or rng.random() < 0.3:
            x = rng.choice("abc")
            return ("name", frozenset((f"}}{x}",))), x
        kind = rng.choice(["seq", "alt", "rep"])
        (m, p), (n, q) = model(depth - 1), model(depth - 1)
        if kind == "seq":
            return xsd_rules.seq(m, n), p + q
        if kind == "alt":
            return xsd_rules.alt((m, n)), f"(?:{p}|{q})"
        low, high = rng.choice([(0, 1), (0, None), (1, None), (2, 3), (0, 2)])
        return xsd_rules.rep(m, low, high), f"(?:{p}){{{low},{'' if high is None else high}}}"

    for _ in range(150):
        m, pattern = model(4)
        for n in range(5):
            for word in itertools.product("abc", repeat=n):
                at = m
                for x in word:
                    at = xsd_rules.after(at, f"}}{x}")
                assert xsd_rules.may_end(at) == bool(re.fullmatch(pattern, "".join(word))), (pattern, word)


def test_names_of_two_namespaces(spark):
    other = ('<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema" targetNamespace="urn:b" xmlns="urn:b"><xs:complexType name="T"><xs:sequence><xs:element name="y" type="xs:string"/></xs:sequence></xs:complexType>'
             '<xs:element name="r" type="T"/></xs:schema>')
    main = ('<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema" targetNamespace="urn:a" xmlns:a="urn:a" xmlns:b="urn:b"><xs:import namespace="urn:b" schemaLocation="b.xsd"/>'
            '<xs:complexType name="T"><xs:sequence><xs:element name="x" type="xs:int"/></xs:sequence></xs:complexType>'
            '<xs:element name="r"><xs:complexType><xs:sequence><xs:element name="t" type="b:T"/><xs:element name="u" type="a:T"/><xs:element ref="b:r" minOccurs="0"/></xs:sequence></xs:complexType></xs:element></xs:schema>')
    model = xsd.compile_xsd(main, lambda ns, where: other)
    assert model.ddl("r") == "struct<t:struct<y:string>,u:struct<x:bigint>,r:struct<y:string>>" and model.ddl("{urn:b}r") == "struct<y:string>"
    good = '<a:r xmlns:a="urn:a" xmlns:b="urn:b"><a:t><b:y/></a:t><a:u><a:x>1</a:x></a:u><b:r><y/></b:r></a:r>'
    assert faults(model.rules, [good, good.replace("b:y", "a:y"), good.replace("<b:r>", "<a:r>").replace("</b:r>", "</a:r>")], "r") == [None, "unexpected r/t/y", "unexpected r/r"]
    with pytest.raises(xsd.SchemaError, match="several namespaces"):
        xsd.compile_xsd(main.replace('type="b:T"', 'type="T"'), lambda ns, where: other)
    with pytest.raises(xsd.SchemaError, match="two namespaces"):
        xsd.compile_xsd(main.replace('name="t" type="b:T"', 'name="r" type="a:T"'), lambda ns, where: other)


def test_recursive_types_end():
    model = xsd.compile_xsd(f'{HEAD}<xs:complexType name="N"><xs:sequence><xs:element name="c" type="N" minOccurs="0"/></xs:sequence></xs:complexType><xs:element name="r" type="N"/></xs:schema>')
    assert model.schema("r").fieldNames() == ["c"]


def test_events_and_simple_form(spark):
    xml = '<?xml version="1.0"?><!DOCTYPE a [<!ENTITY e "ent">]><a xmlns="urn:d" xmlns:p="urn:p" p:k="v" l="w"><?pi data?><b>x &lt; &#65;&e;</b> <p:c/><![CDATA[<raw>]]></a>'
    events = XML.sax_events(docs(spark, xml, None))
    rows = events.orderBy("seq").collect()
    assert [r.event for r in rows if r.event.startswith("start")] == ["startDocument", "startPrefixMapping", "startPrefixMapping", "startElement", "startElement", "startElement"]
    assert {(a.name, a.uri, a.value) for r in rows if r.local_name == "a" for a in r.attrs} == {("k", "urn:p", "v"), ("l", "", "w")}
    form = XML.simple_form(events).orderBy("seq").collect()
    assert [(r.depth, r.name, r.text) for r in form] == [(1, "{urn:d}a", None), (2, "{urn:d}b", "x < Aent"), (2, "{urn:p}c", None)]
    mixed = XML.sax_events(docs(spark, "<a>x<!-- c -->y<b>in</b>z<![CDATA[<raw>]]>w<b/></a>"))
    assert [r.text for r in mixed.where("event = 'characters'").orderBy("seq").collect()] == ["xy", "in", "z", "<raw>", "w"]
    rows = XML.simple_form(mixed, rename=lambda uri, local, prefix: F.upper(local)).orderBy("seq").collect()
    assert [(r.name, r.text, r.texts) for r in rows] == [("A", "xy", ["xy", "z", "<raw>", "w"]), ("B", "in", ["in"]), ("B", None, [])]
    count = XML.fold_events(docs(spark, "<a><b/><b/></a>", None), lambda n, e: n + (e[1] == "startElement"), int, "long", lambda n: n * 10)
    assert [r.value for r in count.orderBy("id").collect()] == [30, None]
    with pytest.raises(PySparkException):
        XML.sax_events(docs(spark, "<a><b></a>")).collect()


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    lit = F.lit
    assert one(X.decode_entities(lit("a &amp;lt; &#65;&#x1F600;&apos;&nbsp;& ;"))) == "a &lt; A\U0001f600'&nbsp;& ;"
    assert one(X.escape_attribute(lit('<a & "b">'))) == "&lt;a &amp; &quot;b&quot;&gt;"
    assert one(X.escape_text(lit('<a & "b">'))) == "&lt;a &amp; &quot;b&quot;>"
    assert [one(X.to_number(lit(t))) for t in ("5", " -1.5e3 ", "x", None)] == [5.0, -1500.0, None, None]
    assert [one(X.number_text(lit(v))) for v in (5.0, 0.25, 1e-7, -3.5)] == ["5", "0.25", "0.0000001", "-3.5"]
    assert [one(X.multiply_occurs(lit(a).cast("long"), lit(b).cast("long"))) for a, b in ((2, 3), (0, None), (None, 2))] == [6, 0, None]
    assert one(X.min_occurs(lit(None).cast("long"), lit(4).cast("long"))) == 4
    assert one(X.detect_encoding(lit(b"<?xml version='1.0' encoding='KOI8-R'?><a/>"))) == "koi8-r"
    assert one(X.detect_encoding(lit("<?xml?>".encode("utf-16-le")))) == "utf-16le"
    assert one(F.size(XML.select_path(lit("<r><m>x</m><m>y</m><m>x</m></r>"), "//m[. = 'x']/text()"))) == 2
    assert one(XML.precise(lit(151.0) / 5, 2)) == "30.20"
    assert [one(X.is_ascii(lit(t))) for t in ("a\nb", "é")] == [True, False]
    assert [one(X.is_latin1(lit(t))) for t in ("é", "Ж")] == [True, False]
    assert one(X.local_name(lit("p:q"))) == "q" and one(X.name_prefix(lit("q"))) == ""


def test_a_reader_is_used_again(spark):
    """One reader for all documents of a task, and batches of many documents: the same events as one by one."""
    docs = ['<a x="1"><p:b xmlns:p="urn:p">t<!-- c -->u</p:b></a>', "<!DOCTYPE a [<!ENTITY e 'v'>]><a>&e;<![CDATA[w]]></a>", "<a>&#233; </a>", "<a/>"]
    reader = XML._reader()
    alone = [XML.events_of(d) for d in docs]
    assert [XML.events_of(d, reader) for d in docs] == alone
    rows = [(i, None if i % 7 == 6 else docs[i % 4]) for i in range(3000)]
    got = XML.sax_events(spark.createDataFrame(rows, "id long, xml string").coalesce(1))
    want = {e: sum(sum(x[1] == e for x in alone[i % 4]) for i, t in rows if t) for e in ("startElement", "endElement", "characters", "startDocument")}
    assert {r.event: r["count"] for r in got.groupBy("event").count().collect() if r.event in want} == want
    assert got.groupBy("id").count().count() == sum(t is not None for _, t in rows)


def test_elements_of_documents(spark):
    """Each element's names as the document has them; equal lists are kept once."""
    lists = xsd_rules._Lists()
    at = [lists[x] for x in (("a", "b"), (), ("c",), ("a", "b"))]
    assert len(lists) == 3 and lists.array(at).to_pylist() == [["a", "b"], [], ["c"], ["a", "b"]]
    xsi = 'xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"'
    texts = [(0, None), (1, "<a>"), (2, f'<a {xsi} k="1" xml:lang="e"><b xsi:type="p:T"><c> </c><!-- t --></b>t<b xsi:nil="1"/><c u:j="2" xmlns:u="u">\n<a>x</a></c></a>')]
    found = spark.createDataFrame(texts, "id int, xml string").select("id", xsd_rules.elements_of(F.col("xml")).alias("v")).orderBy("id").collect()
    assert [(r.v.error or "")[:15] for r in found] == ["", "not well-formed", ""] and [len(r.v.elements) for r in found] == [0, 0, 6]
    assert [(list(e.above), e.name, list(e.kids), list(e.attributes), e.text, e.nil) for e in found[2].v.elements] == [
        ([], "}a", ["}b", "}b", "}c"], ["}k"], True, False), (["}a"], "}b T", ["}c"], [], False, False), (["}a", "}b T"], "}c", [], [], False, False),
        (["}a"], "}b", [], [], False, True), (["}a"], "}c", ["}a"], ["u}j"], False, False), (["}a", "}c"], "}a", [], [], True, False)]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_order_documents_are_dealt_by_key(spark):
    """Small lines are not broadcast: that left all documents to the tasks that read orders."""
    plan = queries.order_xml(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
