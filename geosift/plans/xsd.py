"""XML schemas as Spark schemas: compile an XSD on the driver, read and write typed XML with Spark.

A schema becomes a Model: global elements, each with a tree of fields (name, type, occurrence). The tree
gives a StructType for from_xml and to_xml, and a list of checks: Spark's reader knows neither occurrence
nor required attributes, so these are columns computed from the parsed value.

Mapping: sequence, all and choice -> struct fields (alternatives of a choice are nullable); maxOccurs > 1 ->
array; attributes -> `_name`; simple content and mixed text -> `_VALUE`; integer and int -> bigint, boolean -> boolean, all
other simple types -> string; any -> dropped. Recursive types end at MAX_DEPTH. Mixed content loses the places of
its text. Order, exclusive choices, unexpected content, wildcards, xsi:type and xsi:nil are checked by plans.xsd_rules.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geosift.plans.xsd_rules import RuleCompiler, Rules, first_fault

XS = "{http://www.w3.org/2001/XMLSchema}"
MAX_DEPTH = 10
INTEGERS = frozenset("integer int long short byte nonNegativeInteger positiveInteger unsignedInt unsignedLong negativeInteger nonPositiveInteger".split())


class SchemaError(ValueError):
    pass


@dataclass(frozen=True)
class Field:
    """An element or attribute; high None: unbounded. fields None: simple content of `kind`."""

    name: str
    kind: str = "string"
    low: int = 1
    high: int | None = 1
    fields: tuple[Field, ...] | None = None
    attribute: bool = False
    mixed: bool = False
    nillable: bool = False
    choice: int = 0  # alternatives of the same choice share a number; 0: none
    space: str = ""  # the namespace of an element's schema

    @property
    def column(self) -> str:
        return f"_{self.name}" if self.attribute else self.name

    @property
    def data_type(self) -> T.DataType:
        simple: T.DataType = {"bigint": T.LongType(), "boolean": T.BooleanType()}.get(self.kind, T.StringType())
        base = simple
        if self.fields is not None:
            inner = [T.StructField(f.column, f.data_type) for f in self.fields]
            if self.mixed or self.kind != "struct":
                inner.append(T.StructField("_VALUE", T.StringType() if self.mixed else simple))
            base = T.StructType(inner)
        return base if self.high == 1 else T.ArrayType(base)


@dataclass
class Model:
    elements: dict[str, Field] = field(default_factory=dict)
    bases: dict[str, str] = field(default_factory=dict)  # derived type -> base type
    namespace: str = ""
    rules: Rules | None = None

    def schema(self, element: str) -> T.StructType:
        """The row schema of documents with that root element."""
        if element not in self.elements:
            raise SchemaError(f"no global element {element!r}")
        kind = replace(self.elements[element], high=1).data_type
        return kind if isinstance(kind, T.StructType) else T.StructType([T.StructField("_VALUE", kind)])

    def ddl(self, element: str) -> str:
        """The row schema as text, for writing down."""
        return self.schema(element).simpleString()

    def merge(self, other: Model) -> Model:
        """Both models' elements and types; the first one's definition counts where both have one."""
        rules = self.rules.merged(other.rules) if self.rules and other.rules else None
        return Model({**other.elements, **self.elements}, {**other.bases, **self.bases}, self.namespace or other.namespace, rules)


def _local(name: str) -> str:
    return name.rpartition("}")[2].rpartition(":")[2]


class _Compiler:
    """Definitions are kept by `{namespace}name`; names in attributes are resolved by the prefixes in scope where they stand."""

    KINDS = ("element", "complexType", "simpleType", "group", "attributeGroup", "attribute")
    NAMES = ("type", "ref", "base", "substitutionGroup")

    def __init__(self, resolve: Callable[[str, str], str] | None):
        self.resolve = resolve
        self.found: dict[str, dict[str, ET.Element]] = {k: {} for k in self.KINDS}
        self.substitutes: dict[str, list[str]] = {}
        self.loaded: set[tuple[str, str]] = set()
        self.choices = 0

    def load(self, text: str, around: str = "") -> str:
        """Keep a schema's definitions; around: the target namespace of one that includes it. Its own target namespace."""
        parser, scopes, root, target = ET.XMLPullParser(("start-ns", "end-ns", "start")), [{}], None, ""
        parser.feed(text)
        parser.close()
        for event, node in parser.read_events():
            if event == "start-ns":
                scopes.append({**scopes[-1], node[0]: node[1]})
            elif event == "end-ns":
                scopes.pop()
            else:
                if root is None:
                    root, target = node, node.get("targetNamespace") or around
                node.set("_space", target)
                for key in self.NAMES:
                    if node.get(key):
                        prefix, _, name = node.get(key).rpartition(":")
                        node.set(key, f"{{{scopes[-1].get(prefix, '' if not prefix else prefix)}}}{name}")
        if root.tag != f"{XS}schema":
            raise SchemaError(f"not a schema: {root.tag}")
        for child in root:
            tag = child.tag.removeprefix(XS)
            if tag in ("include", "import", "redefine"):
                where = child.get("schemaLocation") or child.get("namespace") or ""
                key = (child.get("namespace") or "" if tag == "import" else target, where)
                if self.resolve and where and key not in self.loaded:
                    self.loaded.add(key)
                    self.load(self.resolve(child.get("namespace") or "", where), "" if tag == "import" else target)
                for own in child:  # redefine
                    self._keep(own)
            else:
                self._keep(child)
        return target

    def _keep(self, node: ET.Element) -> None:
        tag = node.tag.removeprefix(XS)
        if tag in self.found and node.get("name"):
            name = f"{{{node.get('_space')}}}{node.get('name')}"
            node.set("_name", name)
            self.found[tag][name] = node

    def link(self) -> None:
        """Substitution groups, once all definitions are known."""
        for name, node in self.found["element"].items():
            if node.get("substitutionGroup"):
                head = self.find("element", node.get("substitutionGroup"))
                if head is not None:
                    self.substitutes.setdefault(head.get("_name"), []).append(name)

    def find(self, kind: str, name: str | None) -> ET.Element | None:
        """A definition. A name without namespace may mean one of any namespace (a schema without prefixes), if there is but one."""
        node = self.found[kind].get(name or "")
        if node is None and name and name.startswith("{}"):
            same = [n for k, n in self.found[kind].items() if k.rpartition("}")[2] == name[2:]]
            if len(same) > 1:
                raise SchemaError(f"{kind} {name[2:]!r} is in several namespaces")
            node = same[0] if same else None
        return node

    def get(self, kind: str, name: str) -> ET.Element:
        node = self.find(kind, name)
        if node is None:
            raise SchemaError(f"no {kind} {_local(name)!r}")
        return node

    @staticmethod
    def occurs(node: ET.Element) -> tuple[int, int | None]:
        high = node.get("maxOccurs", "1")
        return int(node.get("minOccurs", "1")), None if high == "unbounded" else int(high)

    def simple(self, name: str) -> str:
        """The scalar kind of a simple type, through restrictions."""
        for _ in range(MAX_DEPTH):
            local = _local(name)
            node = self.find("simpleType", name)
            if node is None:
                return "bigint" if local in INTEGERS else "boolean" if local == "boolean" else "string"
            rest = node.find(f"{XS}restriction")
            if rest is None or not rest.get("base"):
                return "string"  # lists and unions
            name = rest.get("base")
        raise SchemaError(f"simple type {name!r} is nested too deeply")

    def element(self, node: ET.Element, depth: int) -> list[Field]:
        low, high = self.occurs(node)
        if node.get("ref"):
            target = self.get("element", node.get("ref"))
            names = [target]
            for n in names:  # substitutes of substitutes, too
                names += [e for e in (self.found["element"][s] for s in self.substitutes.get(n.get("_name"), [])) if e not in names]
            out = [replace(f, low=low if len(names) == 1 else 0, high=high) for n in names for f in self.element(n, depth)]
            return self._alternatives(out) if len(names) > 1 else out
        one = Field(node.get("name"), low=low, high=high, nillable=node.get("nillable") == "true", space=node.get("_space"))
        inner = node.find(f"{XS}complexType")
        if inner is None and node.get("type"):
            inner = self.find("complexType", node.get("type"))
        if inner is not None:
            kind, fields, mixed = self.complex(inner, depth + 1)
            return [replace(one, kind=kind, fields=tuple(fields), mixed=mixed)]
        simple = node.find(f"{XS}simpleType/{XS}restriction")
        return [replace(one, kind=self.simple(simple.get("base") if simple is not None else node.get("type") or "string"))]

    def complex(self, node: ET.Element, depth: int) -> tuple[str, list[Field], bool]:
        if depth > MAX_DEPTH:
            return "struct", [], False
        mixed = node.get("mixed") == "true"
        content = node.find(f"{XS}simpleContent")
        content = content if content is not None else node.find(f"{XS}complexContent")
        if content is None:
            return "struct", [*self.particles(node, depth), *self.attributes(node, depth)], mixed
        step = next(c for c in content if c.tag in (f"{XS}extension", f"{XS}restriction"))
        base = self.find("complexType", step.get("base"))
        kind, inherited, base_mixed = "struct", [], False
        if base is not None:
            kind, inherited, base_mixed = self.complex(base, depth + 1)
        elif content.tag == f"{XS}simpleContent":
            kind = self.simple(step.get("base") or "")
        own = self.particles(step, depth)
        attributes = {f.name: f for f in [*(f for f in inherited if f.attribute), *self.attributes(step, depth)]}
        elements = [f for f in inherited if not f.attribute] + own if step.tag == f"{XS}extension" else own
        return kind, [*elements, *attributes.values()], mixed or base_mixed or content.get("mixed") == "true"

    def particles(self, node: ET.Element, depth: int, low: int = 1, high: int | None = 1) -> list[Field]:
        """Fields of the groups in node; low and high are the occurrence of what is around them."""
        if depth > MAX_DEPTH:
            raise SchemaError("groups are nested too deeply")
        out: list[Field] = []
        for c in node:
            tag = c.tag.removeprefix(XS)
            lo, hi = self.occurs(c) if tag in ("element", "sequence", "choice", "all", "group") else (1, 1)
            if tag == "element":
                out += [replace(f, low=low * f.low, high=None if high is None or f.high is None else high * f.high) for f in self.element(c, depth)]
            elif tag in ("sequence", "all"):
                out += self.particles(c, depth + 1, low * lo, None if high is None or hi is None else high * hi)
            elif tag == "group":
                out += self.particles(self.get("group", c.get("ref")), depth + 1, low * lo, None if high is None or hi is None else high * hi)
            elif tag == "choice":
                inner = self.particles(c, depth + 1, 0, None if high is None or hi is None else high * hi)
                out += self._alternatives(inner) if low * lo else inner
        return self._unique(out)

    def _alternatives(self, fields: list[Field]) -> list[Field]:
        self.choices += 1
        return [replace(f, low=0, choice=self.choices) for f in fields]

    @staticmethod
    def _unique(fields: list[Field]) -> list[Field]:
        """An element named twice in a content model is one repeated field."""
        out: dict[str, Field] = {}
        for f in fields:
            if f.name in out:
                a = out[f.name]
                if a.space != f.space and not f.attribute:
                    raise SchemaError(f"elements {f.name!r} of two namespaces in one type have no columns of their own")
                f = replace(a, low=min(a.low, f.low), high=None)
            out[f.name] = f
        return list(out.values())

    def attributes(self, node: ET.Element, depth: int) -> list[Field]:
        if depth > MAX_DEPTH:
            raise SchemaError("attribute groups are nested too deeply")
        out: list[Field] = []
        for c in node:
            if c.tag == f"{XS}attribute":
                target = self.get("attribute", c.get("ref")) if c.get("ref") else c
                inner = target.find(f"{XS}simpleType/{XS}restriction")
                kind = self.simple(inner.get("base") if inner is not None else target.get("type") or "string")
                out.append(Field(target.get("name"), kind, low=int(c.get("use") == "required"), attribute=True))
            elif c.tag == f"{XS}attributeGroup":
                out += self.attributes(self.get("attributeGroup", c.get("ref")), depth + 1)
        return out


def compile_xsd(text: str, resolve: Callable[[str, str], str] | None = None) -> Model:
    """resolve(namespace, location) gives the text of an included, imported or redefined schema; each is loaded once."""
    c = _Compiler(resolve)
    namespace = c.load(text)
    c.link()
    bases = {}
    for node in c.found["complexType"].values():
        for step in node.iter():
            if step.tag in (f"{XS}extension", f"{XS}restriction") and step.get("base"):
                bases[node.get("name")] = _local(step.get("base"))
                break
    # Elements go by their local names; one of an imported schema by `{namespace}name` where the main schema has its name, too.
    taken = {n.get("name") for n in c.found["element"].values() if n.get("_space") == namespace}
    name_of = lambda n: n.get("name") if n.get("_space") == namespace or n.get("name") not in taken else n.get("_name")
    elements = {name_of(n): replace(c.element(n, 0)[0], low=1, high=1) for n in c.found["element"].values()}
    return Model(elements, bases, namespace, RuleCompiler(c.found, c.substitutes, c.find).compile(name_of))


def _first_fault(fields: tuple[Field, ...], path: str) -> Callable[[Column], Column]:
    """A function of one array entry."""
    return lambda entry: F.coalesce(*_faults(entry, fields, path), F.lit(None).cast("string"))


def _faults(value: Column, fields: tuple[Field, ...], path: str) -> list[Column]:
    """A text for each broken rule, null where it holds."""
    out, choices = [], {}
    for f in fields:
        v, where = value[f.column], f"{path}/{'@' if f.attribute else ''}{f.name}"
        size = F.coalesce(F.size(v), F.lit(0)) if f.high != 1 else v.isNotNull().cast("int")
        if f.low:
            out.append(F.when(value.isNotNull() & (size < f.low) & (~F.lit(f.nillable)), F.lit(f"missing {where}")))
        if f.high is not None and f.high > 1:
            out.append(F.when(size > f.high, F.lit(f"too many {where}")))
        if f.choice:
            choices.setdefault(f.choice, []).append((size, where))
        if f.fields and f.high == 1:
            out += _faults(v, f.fields, where)
        elif f.fields:
            out.append(F.get(F.filter(F.transform(v, _first_fault(f.fields, where)), lambda t: t.isNotNull()), 0))
    for group in choices.values():
        taken = sum(((s > 0).cast("int") for s, _ in group), F.lit(0))
        names = " or ".join(w for _, w in group)
        out.append(F.when(value.isNotNull() & (taken == 0), F.lit(f"missing {names}")))
    return out


def scan(docs: DataFrame, model: Model, element: str, column: str = "xml", mode: str = "FAILFAST") -> DataFrame:
    """docs with `value`, the typed content of the XML text in column, and `fault`, the first broken rule or null.

    FAILFAST raises on bad XML or a value of the wrong type; PERMISSIVE gives nulls. Occurrence and required attributes are
    judged by expressions on the value; the rest by xsd_rules on the text, where the query asks for `fault`.
    """
    value = F.from_xml(F.col(column), model.schema(element), {"mode": mode, "rowTag": element, "ignoreNamespace": "true"})
    rows = docs.withColumn("value", value)
    rules = _faults(F.col("value"), model.elements[element].fields or (), element)
    more = [first_fault(F.col(column), model.rules, element)] if model.rules else []
    return rows.withColumn("fault", F.coalesce(*rules, *more, F.lit(None).cast("string")))


def write(rows: DataFrame, model: Model, element: str, column: str = "value", *, strict: bool = True) -> Column:
    """The XML text of a typed value: the inverse of scan. strict: a broken rule raises."""
    xml = F.to_xml(F.col(column), {"rowTag": element, "indent": "", "ignoreSurroundingSpaces": "false"})
    rules = _faults(F.col(column), model.elements[element].fields or (), element)
    if strict and rules:
        fault = F.coalesce(*rules)
        xml = F.when(fault.isNotNull(), F.raise_error(fault)).otherwise(xml)
    return xml
