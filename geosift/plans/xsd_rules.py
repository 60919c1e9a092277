"""The rules of an XML schema that a Spark schema cannot hold: order, exclusive choices, unexpected content, wildcards, derived types.

Content models become automata when a schema is compiled: the states are the derivatives of a model, with counters for
occurrence, and a state's transitions are a small map from child names to states. All types of a schema share one table of states. Documents become
arrays of their elements (names of the ancestors, of the children, of the attributes), and the rules are Column expressions
over these: a fold over the ancestors' names gives an element's type, a fold over the children's names runs the
automaton, one step a child, whatever the nesting of groups and occurrences. Types are looked up by name, so recursive ones have no end to be set.

Decisions: names are pairs of namespace and local name; an element may have its schema's target namespace or none, whatever the
form; an element that only a wildcard admits is not looked into; xsi:type must name the declared type or one derived from it; xsi:nil
needs a nillable element without content; other xsi: attributes are ignored; xml: attributes are free. A schema whose
automata have over STATES states (occurrence counted to such a height) is an error when it is compiled.
"""

from __future__ import annotations

import functools
import itertools
import json
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

XS = "{http://www.w3.org/2001/XMLSchema}"
XSI = "{http://www.w3.org/2001/XMLSchema-instance}"
XML_ATTRIBUTE = "{http://www.w3.org/XML/1998/namespace}"
STATES = 50_000
OTHER = "!}*"  # any name of a namespace that the schema does not mention

# Content models: EMPTY, NOTHING (no children), ("name", tokens), ("any", spaces), ("seq", a, b), ("alt", models), ("rep", model, low, high).
# A token is `namespace}name`. Spaces of a wildcard: "*", "=namespace", "!namespace" (any other one, but not none).
EMPTY, NOTHING = ("empty",), ("nothing",)
Content = tuple


def seq(a: Content, b: Content) -> Content:
    if EMPTY in (a, b):
        return EMPTY
    if a == NOTHING or b == NOTHING:
        return b if a == NOTHING else a
    return seq(a[1], seq(a[2], b)) if a[0] == "seq" else ("seq", a, b)


def alt(models: Iterable[Content]) -> Content:
    flat = frozenset(x for m in models for x in (m[1] if m[0] == "alt" else (m,)) if x != EMPTY)
    return EMPTY if not flat else next(iter(flat)) if len(flat) == 1 else ("alt", flat)


def rep(model: Content, low: int, high: int | None) -> Content:
    if high == 0 or model == NOTHING or model == EMPTY and low == 0:
        return NOTHING
    return model if (low, high) == (1, 1) or model == EMPTY else ("rep", model, low, high)


@functools.cache
def may_end(m: Content) -> bool:
    kind = m[0]
    return kind == "nothing" or kind == "seq" and may_end(m[1]) and may_end(m[2]) or kind == "alt" and any(map(may_end, m[1])) or kind == "rep" and (m[2] == 0 or may_end(m[1]))


def admits(spaces: frozenset[str], token: str) -> bool:
    space = token.partition("}")[0]
    if token == OTHER:
        return any(s[0] in "*!" for s in spaces)
    return any(s == "*" or s == f"={space}" or s[0] == "!" and space and s[1:] != space for s in spaces)


@functools.cache
def after(m: Content, token: str) -> Content:
    """What may follow once a child with this name has been read."""
    kind = m[0]
    if kind == "name":
        return NOTHING if token in m[1] else EMPTY
    if kind == "any":
        return NOTHING if admits(m[1], token) else EMPTY
    if kind == "seq":
        first = seq(after(m[1], token), m[2])
        return alt((first, after(m[2], token))) if may_end(m[1]) else first
    if kind == "alt":
        return alt(after(x, token) for x in m[1])
    if kind == "rep":
        return seq(after(m[1], token), rep(m[1], max(m[2] - 1, 0), None if m[3] is None else m[3] - 1))
    return EMPTY


def tokens_of(m: Content) -> set[str]:
    if m[0] == "name":
        return set(m[1])
    return set().union(*map(tokens_of, m[1] if m[0] == "alt" else m[1:3] if m[0] == "seq" else m[1:2])) if m[0] in ("seq", "alt", "rep") else set()


@dataclass
class Kind:
    """A type: its content model (None: simple content), what it knows by name, and what it allows besides."""

    content: Content | None = None
    space: str = ""
    children: dict[str, tuple[str, bool]] = field(default_factory=dict)  # token -> type, nillable
    attributes: dict[str, bool] = field(default_factory=dict)  # name -> required
    any_attribute: frozenset[str] = frozenset()
    wildcards: list[frozenset[str]] = field(default_factory=list)
    mixed: bool = False
    unordered: tuple[tuple[str, bool], ...] | None = None  # of `all`: name, required


@dataclass
class Rules:
    """Types by name; "" is free text. Global elements: name -> type, nillable, namespace."""

    kinds: dict[str, Kind]
    elements: dict[str, tuple[str, bool, str]]
    bases: dict[str, str]

    def merged(self, other: Rules) -> Rules:
        """Both; the first one's definition counts. Names of inline types may be used in both: they are told apart."""
        name = lambda n: n + "'" if "#" in n else n
        kinds = {name(n): Kind(k.content, k.space, {c: (name(t), nil) for c, (t, nil) in k.children.items()}, k.attributes, k.any_attribute, k.wildcards, k.mixed, k.unordered) for n, k in other.kinds.items()}
        return Rules({**kinds, **self.kinds}, {**{e: (name(t), nil, s) for e, (t, nil, s) in other.elements.items()}, **self.elements}, {**other.bases, **self.bases})

    def is_kind_of(self, name: str, base: str) -> bool:
        seen = set()
        while name not in seen:
            if name == base:
                return True
            seen.add(name)
            name = self.bases.get(name, name)
        return False

    def tables(self, root: str) -> dict:
        """All that the expressions look up, by type number and state; type 0 stands for the document."""
        names = ["", *(n for n in self.kinds if n)]
        number = {n: i + 1 for i, n in enumerate(names)}
        kinds = [Kind(), *(self.kinds.get(n) or Kind() for n in names)]
        if root in self.elements:
            kind, nil, space = self.elements[root]
            kinds[0].children = dict.fromkeys((f"}}{root}", f"{space}}}{root}"), (kind, nil))
        spaces = sorted({"", *(k.space for k in kinds), *(s[1:] for k in kinds for w in [*k.wildcards, k.any_attribute] for s in w if s[0] in "=!")})
        rows: list[dict[str, int]] = []
        ends: list[bool] = []
        starts = []
        for k in kinds:
            if k.content is None or k.unordered is not None:
                starts.append(-1)
                continue
            letters, own, todo = [*sorted(tokens_of(k.content)), *(f"{s}}}*" for s in spaces), OTHER], {}, [k.content]
            starts.append(len(rows))
            own[k.content] = len(rows)
            for m in todo:  # grows
                if own[m] >= STATES:
                    raise ValueError(f"the content models need over {STATES} states")
                row: dict[str, int] = {}
                rows.append(row)
                ends.append(may_end(m))
                for letter in letters:
                    to = after(m, letter)
                    if to != EMPTY:
                        if to not in own:
                            own[to] = own[k.content] + len(own)
                            todo.append(to)
                        row[letter] = own[to]
        local = lambda n: n.rpartition("}")[2]
        derived = [{}, *({local(n): number[n] for n in reversed(names) if n and "#" not in n and self.is_kind_of(n, base)} for base in names)]
        return {"rows": rows, "ends": ends, "spaces": spaces, "kinds": [{
            "kids": {c: number.get(t, 1) for c, (t, _) in k.children.items()}, "nils": {c: nil for c, (_, nil) in k.children.items()}, "required": [a for a, r in k.attributes.items() if r],
            "attributes": [f"{s}}}{a}" for a in k.attributes for s in dict.fromkeys(("", k.space))], "any_attribute": sorted(k.any_attribute), "wildcards": sorted(set().union(*k.wildcards)),
            "space": k.space, "simple": k.content is None, "mixed": k.mixed, "start": start, "unordered": k.unordered is not None, "all_required": [n for n, r in k.unordered or () if r],
            "all_names": [n for n, _ in k.unordered or ()], "derived": own} for k, start, own in zip(kinds, starts, derived, strict=True)]}


TABLES = ("struct<rows:array<map<string,int>>,ends:array<boolean>,spaces:array<string>,kinds:array<struct<kids:map<string,int>,nils:map<string,boolean>,required:array<string>,"
          "attributes:array<string>,any_attribute:array<string>,wildcards:array<string>,space:string,simple:boolean,mixed:boolean,start:int,unordered:boolean,"
          "all_required:array<string>,all_names:array<string>,derived:map<string,int>>>>")
ELEMENTS = "struct<error:string,elements:array<struct<above:array<string>,name:string,kids:array<string>,attributes:array<string>,text:boolean,nil:boolean>>>"


def _token(tag: str) -> str:
    return tag[1:] if tag[0] == "{" else f"}}{tag}"


class _Tokens(dict):
    """Tokens by the names that ElementTree gives, each made once."""

    def __missing__(self, tag: str) -> str:
        out = self[tag] = _token(tag)
        return out


class _Lists(dict):
    """Different lists, numbered as they come; 0 is the empty one."""

    def __init__(self) -> None:
        super().__init__({(): 0})

    def __missing__(self, items: tuple[str, ...]) -> int:
        out = self[items] = len(self)
        return out

    def array(self, at: list[int]) -> pa.Array:
        """The lists with these numbers, one a row."""
        flat = pa.array([x for items in self for x in items], pa.string())
        ends = pa.array([0, *itertools.accumulate(map(len, self))], pa.int32())
        return pa.ListArray.from_arrays(ends, flat).take(pa.array(at, pa.int64()))


def elements_of(document: Column) -> Column:
    """An XML text's elements in document order: the names above each, of itself, its children and attributes; or why it cannot be read.

    A name is `namespace}local`, with a space and the local name of its xsi:type behind it where it has one.
    """
    @F.arrow_udf(ELEMENTS)
    def parse(texts: pa.Array) -> pa.Array:
        paths, kids, attributes, token = _Lists(), _Lists(), _Lists(), _Tokens()
        above, names, inside, marks, text, nil, ends, errors = [], [], [], [], [], [], [0], []
        for document in texts.to_pylist():
            errors.append(None)
            try:
                todo = [] if document is None else [(iter((ET.fromstring(document),)), (), 0)]
            except ET.ParseError as e:
                errors[-1], todo = f"not well-formed: {e}", []
            while todo:
                nodes, over, place = todo[-1]
                for node in nodes:  # goes on where it was left
                    name, own, inner = token[node.tag], node.keys(), len(node)
                    if own:
                        kind = node.get(f"{XSI}type")
                        if kind:
                            name = f"{name} {kind.rpartition(':')[2]}"
                        marks.append(attributes[tuple(token[a] for a in own if not a.startswith((XSI, XML_ATTRIBUTE)))])
                        nil.append(node.get(f"{XSI}nil") in ("true", "1"))
                    else:
                        marks.append(0)
                        nil.append(False)
                    above.append(place)
                    names.append(name)
                    said = node.text
                    seen = bool(said) and not said.isspace()
                    if not inner:
                        inside.append(0)
                        text.append(seen)
                        continue
                    inside.append(kids[tuple([token[c.tag] for c in node])])
                    text.append(seen or any(c.tail and not c.tail.isspace() for c in node))
                    path = (*over, name)
                    todo.append((iter(node), path, paths[path]))
                    break
                else:
                    todo.pop()
            ends.append(len(names))
        rows = pa.StructArray.from_arrays([paths.array(above), pa.array(names, pa.string()), kids.array(inside), attributes.array(marks), pa.array(text, pa.bool_()), pa.array(nil, pa.bool_())],
                                          names=["above", "name", "kids", "attributes", "text", "nil"])
        return pa.StructArray.from_arrays([pa.array(errors, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)], names=["error", "elements"])

    return parse(document)


def _name(step: Column) -> Column:
    return F.substring_index(step, " ", 1)


def _own(step: Column) -> Column:
    """The xsi:type of a name, or null."""
    return F.when(F.contains(step, F.lit(" ")), F.substring_index(step, " ", -1))


def _local(token: Column) -> Column:
    return F.substring_index(_name(token), "}", -1)


def _admitted(spaces: Column, token: Column) -> Column:
    space = F.substring_index(token, "}", 1)
    return F.exists(spaces, lambda s: (s == "*") | (s == F.concat(F.lit("="), space)) | (s.startswith("!") & (space != "") & (F.substr(s, F.lit(2)) != space)))


def fault_of(elements: Column, rules: Rules, root: str) -> Column:
    """The first broken rule of a document (a column of `elements_of`), null where there is none."""
    r = F.from_json(F.lit(json.dumps(rules.tables(root))), TABLES)  # a constant: folded once
    none = F.lit(None).cast("string")

    kind_at = lambda number: F.get(r["kinds"], number)

    def above(number: Column, step: Column) -> Column:
        """The type of a child by its parent's; -1: not looked into, or a wrong xsi:type."""
        declared = kind_at(number)["kids"][_name(step)]
        return F.coalesce(F.when(_own(step).isNull(), declared).otherwise(kind_at(declared)["derived"][_own(step)]), F.lit(-1))

    def content(e: Column, t: Column, path: Column) -> Column:
        kids = e["kids"]

        def step(state: Column, kid: Column) -> Column:
            row, space = F.get(r["rows"], state), F.substring_index(kid, "}", 1)
            group = F.when(F.array_contains(r["spaces"], space), F.concat(space, F.lit("}*"))).otherwise(F.lit(OTHER))
            return F.when(state < 0, state).otherwise(F.coalesce(row[kid], row[group], F.lit(-1)))

        end = F.aggregate(kids, t["start"], step)
        stray = F.get(F.filter(kids, lambda k: ~F.map_contains_key(t["kids"], k) & ~_admitted(t["wildcards"], k)), F.lit(0))
        names = F.array_join(F.transform(kids, _local), " ")
        wrong = F.coalesce(F.concat(F.lit("unexpected "), path, F.lit("/"), _local(stray)),
                           F.concat(F.lit("wrong content of "), path, F.when(F.size(kids) > 0, F.concat(F.lit(": "), names)).otherwise("")))
        # A repeat or a stranger is among the first children, one more than there are names.
        first = F.slice(F.transform(kids, _local), F.lit(1), F.size(t["all_names"]) + 1)
        missing = F.get(F.filter(t["all_required"], lambda n: ~F.exists(kids, lambda k: _local(k) == n)), F.lit(0))
        odd = F.get(F.filter(F.transform(first, lambda n, i: F.when(~F.map_contains_key(t["kids"], F.get(kids, i)), F.concat(F.lit("unexpected "), path, F.lit("/"), n)).when(
            F.array_position(first, n) <= i, F.concat(F.lit("too many "), path, F.lit("/"), n))), lambda x: x.isNotNull()), F.lit(0))
        return F.when(t["unordered"], F.coalesce(F.concat(F.lit("missing "), path, F.lit("/"), missing), odd)).when(~F.coalesce(F.get(r["ends"], end), F.lit(False)), wrong)

    def of_element(x: Column) -> Column:
        """x: an element e with its declared type and its own."""
        e, t = x["e"], x["t"]
        path = F.concat(F.array_join(F.transform(e["above"], lambda s: F.concat(_local(s), F.lit("/"))), ""), _local(e["name"]))
        lacks = F.get(F.filter(t["required"], lambda a: ~F.array_contains(e["attributes"], F.concat(F.lit("}"), a)) & ~F.array_contains(e["attributes"], F.concat(t["space"], F.lit("}"), a))), F.lit(0))
        extra = F.get(F.filter(e["attributes"], lambda a: ~F.array_contains(t["attributes"], a) & ~_admitted(t["any_attribute"], a)), F.lit(0))
        nil = x["nillable"] & (F.size(e["kids"]) == 0) & ~e["text"]
        return (F.when(x["unknown"], F.when(F.size(e["above"]) == 0, F.concat(F.lit("unexpected root "), _local(e["name"]))))
                .when(t.isNull(), F.concat(F.lit("wrong type "), _own(e["name"]), F.lit(" of "), path))
                .when((F.size(t["required"]) > 0) & lacks.isNotNull(), F.concat(F.lit("missing "), path, F.lit("/@"), lacks))
                .when((F.size(e["attributes"]) > 0) & extra.isNotNull(), F.concat(F.lit("unexpected "), path, F.lit("/@"), _local(extra)))
                .when(e["nil"], F.when(~nil, F.concat(F.lit("wrong nil "), path)))
                .when(t["simple"], F.when(F.size(e["kids"]) > 0, F.concat(F.lit("unexpected "), path, F.lit("/"), _local(F.get(e["kids"], F.lit(0))))))
                .when(e["text"] & ~t["mixed"], F.concat(F.lit("unexpected text in "), path))
                .otherwise(content(e, t, path)))

    # Each step's result is a field of the next one's struct, so that it is computed once.
    placed = F.transform(elements["elements"], lambda e: F.struct(e.alias("e"), kind_at(F.aggregate(e["above"], F.lit(0), above)).alias("parent")))
    named = F.transform(placed, lambda x: F.struct(x["e"].alias("e"), kind_at(x["parent"]["kids"][_name(x["e"]["name"])]).alias("declared"), x["parent"]["nils"][_name(x["e"]["name"])].alias("nillable")))
    typed = F.transform(named, lambda x: F.struct(x["e"].alias("e"), x["nillable"].alias("nillable"), x["declared"].isNull().alias("unknown"),
                                                  F.when(_own(x["e"]["name"]).isNull(), x["declared"]).otherwise(kind_at(x["declared"]["derived"][_own(x["e"]["name"])])).alias("t")))
    first = F.get(F.filter(F.transform(typed, of_element), lambda f: f.isNotNull()), F.lit(0))
    return F.coalesce(elements["error"], first, none)


def first_fault(document: Column, rules: Rules, element: str) -> Column:
    """The first broken rule of each XML text, null where there is none."""
    return fault_of(elements_of(document), rules, element)


def _wildcard(spaces: str, target: str) -> frozenset[str]:
    if spaces == "##any":
        return frozenset("*")
    if spaces == "##other":
        return frozenset((f"!{target}",))
    return frozenset("=" + ("" if s == "##local" else target if s == "##targetNamespace" else s) for s in spaces.split())


class RuleCompiler:
    """Rules of the schemas that `found` holds: find(kind, name) gives a node, named by namespace and local name; nodes know their schema's target namespace."""

    def __init__(self, found: dict[str, dict[str, ET.Element]], substitutes: dict[str, list[str]], find: Callable[[str, str | None], ET.Element | None]):
        self.found, self.substitutes, self.find = found, substitutes, find
        self.kinds: dict[str, Kind] = {"": Kind()}
        self.bases: dict[str, str] = {}

    def compile(self, name_of: Callable[[ET.Element], str]) -> Rules:
        """name_of: the name that a global element goes by among all."""
        for name, node in self.found["complexType"].items():
            self.kind(name, node)
        return Rules(self.kinds, {name_of(node): (*self.typed(node, name), node.get("_space")) for name, node in self.found["element"].items()}, self.bases)

    def typed(self, node: ET.Element, path: str) -> tuple[str, bool]:
        nillable = node.get("nillable") == "true"
        inner = node.find(f"{XS}complexType")
        if inner is not None:
            name = f"{path}#{len(self.kinds)}"
            self.kind(name, inner)
            return name, nillable
        if not node.get("type") and node.get("substitutionGroup"):
            head = self.find("element", node.get("substitutionGroup"))
            return (self.typed(head, path)[0] if head is not None else ""), nillable
        type_ = self.find("complexType", node.get("type"))
        return (type_.get("_name") if type_ is not None else ""), nillable

    def kind(self, name: str, node: ET.Element) -> Kind:
        if name in self.kinds:
            return self.kinds[name]
        kind = self.kinds[name] = Kind(space=node.get("_space"), mixed=node.get("mixed") == "true")
        step = node
        for content in (node.find(f"{XS}simpleContent"), node.find(f"{XS}complexContent")):
            if content is not None:
                kind.mixed = kind.mixed or content.get("mixed") == "true"
                step = next(c for c in content if c.tag in (f"{XS}extension", f"{XS}restriction"))
        if step is node:
            kind.content = self.particles(node, kind, name)
            self.attributes(node, kind)
            return kind
        base = self.find("complexType", step.get("base"))
        parent = self.kind(base.get("_name"), base) if base is not None else Kind()
        if base is not None:
            self.bases[name] = base.get("_name")
        kind.attributes, kind.any_attribute, kind.mixed = dict(parent.attributes), parent.any_attribute, kind.mixed or parent.mixed
        own = self.particles(step, kind, name)
        if node.find(f"{XS}complexContent") is not None:
            if step.tag == f"{XS}extension":
                kind.children, kind.wildcards = {**parent.children, **kind.children}, parent.wildcards + kind.wildcards
                own = seq(parent.content or NOTHING, own)
                kind.unordered = kind.unordered or parent.unordered
            kind.content = own
        self.attributes(step, kind)
        return kind

    def particles(self, node: ET.Element, kind: Kind, path: str) -> Content:
        """The model of the groups and elements in node, one after the other; what they name goes to kind."""
        return functools.reduce(lambda rest, m: seq(m, rest), [self.particle(c, kind, path) for c in node][::-1], NOTHING)

    def particle(self, c: ET.Element, kind: Kind, path: str) -> Content:
        tag = c.tag.removeprefix(XS)
        if tag not in ("element", "sequence", "choice", "all", "group", "any"):
            return NOTHING
        high = c.get("maxOccurs", "1")
        low, most = int(c.get("minOccurs", "1")), None if high == "unbounded" else int(high)
        if tag == "element":
            return rep(self.element(c, kind, path), low, most)
        if tag == "any":
            kind.wildcards.append(_wildcard(c.get("namespace", "##any"), c.get("_space")))
            return rep(("any", kind.wildcards[-1]), low, most)
        if tag == "group":
            return rep(self.particles(self.find("group", c.get("ref")), kind, path), low, most)
        if tag == "choice":
            return rep(alt([self.particle(x, kind, path) for x in c if x.tag != f"{XS}annotation"]), low, most)
        inner = self.particles(c, kind, path)
        if tag == "all":
            kind.unordered = tuple(((x.get("name") or x.get("ref").rpartition("}")[2]), x.get("minOccurs", "1") != "0" and low > 0) for x in c if x.tag == f"{XS}element")
        return rep(inner, low, most)

    def element(self, c: ET.Element, kind: Kind, path: str) -> Content:
        nodes = self.all_substitutes(self.find("element", c.get("ref"))) if c.get("ref") else [c]
        out = set()
        for n in nodes:
            known = self.typed(n, n.get("_name") if c.get("ref") else f"{path}/{c.get('name')}")
            for token in (f"}}{n.get('name')}", f"{n.get('_space')}}}{n.get('name')}"):
                out.add(token)
                kind.children[token] = known
        return "name", frozenset(out)

    def all_substitutes(self, node: ET.Element) -> list[ET.Element]:
        """An element and all that may stand for it, over any number of steps."""
        out = [node]
        for n in out:
            out += [s for s in (self.found["element"][x] for x in self.substitutes.get(n.get("_name"), [])) if s not in out]
        return [n for n in out if n.get("abstract") != "true"] or out

    def attributes(self, node: ET.Element, kind: Kind) -> None:
        for c in node:
            if c.tag == f"{XS}attribute":
                kind.attributes[c.get("name") or c.get("ref").rpartition("}")[2]] = c.get("use") == "required"
            elif c.tag == f"{XS}attributeGroup":
                self.attributes(self.find("attributeGroup", c.get("ref")), kind)
            elif c.tag == f"{XS}anyAttribute":
                kind.any_attribute = _wildcard(c.get("namespace", "##any"), c.get("_space"))
