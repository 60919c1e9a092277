"""Conversation structure repair: the cheapest edits that make a conversation's roles `(s?(ua)+)?`, by cost layers.

For each cost, in increasing order, a layer holds a bitset of grammar states for each turn: those from which the rest of the
conversation can be accepted at exactly that cost. A layer follows from the layers that an edit's cost lies below it. The first
layer whose first bitset has the start state gives the cost, and a walk forward through the bits, which takes the
ASCII-least letter whose bit is set at each step, gives the least audit. Costs that a row has in any case are
added beside the layers.

Rows are counted by (conversation, turn, role, text), sorted by range over all conversations, and read in order, so a conversation may lie on
several tasks. One that a task holds whole is repaired there. Of others each task gives a chunk: for every pair of
grammar states the least cost and audit from one to the other, from blocks of BLOCK rows which combine
associatively (a block's audits end with a row's own letter, so none is a prefix of another, and the least of a chain is the chain
of the least). A conversation's chunks, one a task at most, are combined in order. Its repaired text is then
hashed in a stream, because SHA-256 has no parallel form; no task holds the texts of a conversation of over HELD bytes.

Defined results:
- a null role or text is one space. Rows go by turn, null turns first; rows of one turn by role, then text, by code points.
- a null conv_id is a conversation. Rows that agree in conversation, turn, role and text are repeats: the second is a duplicate.
- empty roles and texts are allowed (the initial is then empty; the text is blank). Texts of any length are read whole.
- no rows: no conversations. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geosift.llm.common import small, small_batches, stage, temporary

BLOCK = 64  # rows of a block whose layers are built together
HELD = 16 << 20  # bytes of text of a conversation that a task holds to hash it at once
SPACE = " \t\n\v\f\r"
LEGAL = {"su", "ua", "au"}
# States: nothing yet, after a system row, after a user row, after an assistant row.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
NEXT = (2, 2, 3, 2)  # where a user or assistant row leads, whichever fits
FIRST, LAST, DONE = 0, 3, 0b1001  # the start, the state that any other can reach, the accepting states
INSERT, RELABEL = 2, 2
SLACK = 3  # no way through a block that costs so much more than one to LAST is ever best
# A row's code is kind * 4 + role; kinds: sound, truncated, to be deleted; roles: s, u, a, another.
SOUND, TRUNCATED, FORCED = 0, 4, 8
ROLES = {"s": 0, "u": 1, "a": 2}
BASE = (0, 1, 3)  # what a row of a kind costs in any case
DELETE = (3, 2, 0)  # what deleting it costs beyond that


def _before(step) -> tuple[int, ...]:
    """For each set of states, the states that a step leads from into it."""
    return tuple(sum(1 << q for q in range(4) if (to := step(q)) is not None and after >> to & 1) for after in range(16))


_KEEP = tuple(_before(lambda q, r=r: STEP.get((q, r))) for r in "sua?")
_FIT = _before(lambda q: NEXT[q])


class Layers:
    """Bitsets of states by cost and row: from which states the rest of the rows reaches `ends` at exactly that cost."""

    def __init__(self, codes: bytes, ends: int, closing: bool):
        self.codes, self.ends, self.closing, self.sets = codes, ends, closing, []

    def grow(self) -> int:
        """Add the next cost's layer; its first bitset."""
        k, n, sets = len(self.sets), len(self.codes), self.sets
        row = bytearray(n + 1)
        two = sets[k - 2] if k >= 2 else None  # an insertion and a new role cost two
        three = sets[k - 3] if k >= 3 else None
        row[n] = after = (self.ends if k == 0 else 0) | (_FIT[two[n]] if two and self.closing else 0)
        for i in range(n - 1, -1, -1):
            code = self.codes[i]
            if code >= FORCED:
                now = after
            else:
                now = _KEEP[code & 3][after]
                if two:
                    now |= _FIT[two[i + 1]]
                    if code >= TRUNCATED:
                        now |= two[i + 1]
                if three and code < TRUNCATED:
                    now |= three[i + 1]
            if two:
                now |= _FIT[two[i]]
            row[i] = after = now
        sets.append(row)
        return after

    def trace(self, state: int, k: int) -> str:
        """The least audit of cost k from a state that is in layer k's first bitset."""
        out, i, sets = [], 0, self.sets
        while i < len(self.codes) or k:
            code = self.codes[i] if i < len(self.codes) else None
            cost = DELETE[code >> 2] if code is not None else 0
            if code is not None and k >= cost and sets[k - cost][i + 1] >> state & 1:
                out.append("D")
                i, k = i + 1, k - cost
            elif k >= INSERT and sets[k - INSERT][i] >> NEXT[state] & 1 and (code is not None or self.closing):
                out.append("I")
                state, k = NEXT[state], k - INSERT
            elif code < FORCED and _KEEP[code & 3][sets[k][i + 1]] >> state & 1:
                out.append("K")
                state, i = STEP[state, "sua"[code & 3]], i + 1
            else:
                out.append("R")
                state, i, k = NEXT[state], i + 1, k - RELABEL
        return "".join(out)


def base_cost(codes: bytes) -> int:
    return sum(BASE[c >> 2] for c in codes)


def repair_whole(codes: bytes) -> tuple[int, str]:
    """Least cost and least audit of a whole conversation."""
    if len(codes) > BLOCK:
        return close(segment(codes))
    layers = Layers(codes, DONE, closing=True)
    while not layers.grow() >> FIRST & 1:
        pass
    k = len(layers.sets) - 1
    return base_cost(codes) + k, layers.trace(FIRST, k)


Ways = dict[tuple[int, int], tuple[int, str]]  # (state before, state after) -> least cost and audit


def _block(codes: bytes) -> Ways:
    ways, base, worst = {}, base_cost(codes), None
    for end in (LAST, 0, 1, 2):
        layers, missing = Layers(codes, 1 << end, closing=False), {0, 1, 2, 3}
        while missing and (worst is None or len(layers.sets) <= worst + SLACK):
            states = layers.grow()
            for s in [s for s in missing if states >> s & 1]:
                k = len(layers.sets) - 1
                ways[s, end] = (base + k, layers.trace(s, k))
                missing.discard(s)
        if worst is None:
            worst = len(layers.sets) - 1
    return ways


def combine(a: Ways, b: Ways) -> Ways:
    """The ways through one part and the next."""
    out: Ways = {}
    for (s, m), (cost, audit) in a.items():
        for t in range(4):
            if (m, t) in b:
                more, rest = b[m, t]
                old = out.get((s, t))
                if old is None or cost + more < old[0] or cost + more == old[0] and audit + rest < old[1]:
                    out[s, t] = (cost + more, audit + rest)
    return out


def segment(codes: bytes) -> Ways:
    """The ways through any number of rows."""
    parts = [_block(codes[i : i + BLOCK]) for i in range(0, len(codes), BLOCK)]
    while len(parts) > 1:  # in pairs, so that audits are copied a logarithm of times
        parts = [combine(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def close(ways: Ways) -> tuple[int, str]:
    """The best way through a whole conversation: what it still lacks is inserted at the end."""
    lacks = {0: "", 1: "II", 2: "I", 3: ""}
    return min((cost + INSERT * len(lacks[t]), audit + lacks[t]) for (s, t), (cost, audit) in ways.items() if s == FIRST)


def repaired(rows: Iterable[tuple[str, str]], audit: Iterable[str]) -> Iterator[tuple[str, str]]:
    """(role, text) after the edits; rows are read as the letters need them."""
    rows, state = iter(rows), FIRST
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        if letter == "K":
            state = STEP[state, role[:1]]
        else:
            state = NEXT[state]
            role = "user" if state == 2 else "assistant"
        yield role, text


def digest(turns: Iterable[tuple[str, str]]) -> str:
    h, first = hashlib.sha256(), True
    for role, text in turns:
        h.update(f"{'' if first else '\n'}{role}:{text}".encode())
        first = False
    return h.hexdigest()


class _Chunk:
    """The rows of a conversation that one task has read so far."""

    def __init__(self, first: bool):
        self.open = first  # may have rows on an earlier task
        self.codes, self.counts = bytearray(), {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.texts: list[tuple[str, str, int]] | None = []
        self.held, self.first, self.last = 0, None, None

    def add(self, role: str, text: str, n: int, is_first: bool) -> None:
        told, x = text.rstrip(SPACE), role[:1]
        if not told:
            self.codes += bytes([FORCED]) * n
            self.counts["blank"] += n
        else:
            copies = n - is_first
            if is_first:
                cut = told[-1] not in ".!?"
                self.codes.append((TRUNCATED if cut else SOUND) + ROLES.get(x, 3))
                self.counts["truncated"] += cut
            self.codes += bytes([FORCED]) * copies
            self.counts["duplicate"] += copies
        self.counts["illegal"] += n - 1 + (self.last is not None and self.last + x not in LEGAL)
        self.first, self.last = x if self.first is None else self.first, x
        if self.texts is not None:
            self.texts.append((role, text, n))
            self.held += len(text) + 100
            if self.held > HELD:
                self.texts, self.open = None, True

    def row(self, conv, part: int) -> dict:
        codes, sha = bytes(self.codes), None
        if self.open:
            ways = segment(codes)
        else:
            cost, audit = repair_whole(codes)
            ways = {(FIRST, LAST): (cost, audit)}
            sha = digest(repaired(((r, t) for r, t, n in self.texts for _ in range(n)), audit))
        return self.counts | {"conv_id": conv, "part": part, "first": self.first, "last": self.last, "sha": sha,
                              "ways": [{"s": s, "t": t, "cost": c, "audit": a} for (s, t), (c, a) in ways.items()]}


COUNTS = ("blank", "duplicate", "truncated", "illegal")


def _ordered(rows: DataFrame) -> DataFrame:
    """rows with a copy count instead of repeats."""
    return rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))


def _chunks(rows: DataFrame, kind: str) -> DataFrame:
    """One row for each conversation and task: its counts, and its hash or the ways through it."""
    fields = f"{', '.join(f'{c} long' for c in COUNTS)}, conv_id {kind}, part int, first string, last string, sha string, ways array<struct<s int, t int, cost long, audit string>>"
    order = ["conv_id", "turn", "role", "text"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    empty = rows.sparkSession.createDataFrame([], fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, chunk, done = TaskContext.get().partitionId(), None, None, []
        schema = None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(done, schema=schema)

        for b in batches:
            schema = schema or pa.schema([*[(c, pa.int64()) for c in COUNTS], ("conv_id", b.schema.field("conv_id").type), ("part", pa.int32()), ("first", pa.string()), ("last", pa.string()), ("sha", pa.string()),
                                          ("ways", pa.list_(pa.struct([("s", pa.int32()), ("t", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])))])
            for conv, role, text, n, is_first in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text", "n", "is_first")), strict=True):
                if chunk is None or conv != now:
                    if chunk:
                        done.append(chunk.row(now, part))
                    chunk, now = _Chunk(first=chunk is None), conv
                chunk.add(role, text, n, is_first)
            if len(done) >= 1_000:
                yield out()
                done = []
        if chunk:
            chunk.open = True  # the next task may have more of it
            done.append(chunk.row(now, part))
            yield out()

    return placed.select("conv_id", "role", "text", "n", "is_first").mapInArrow(run, empty.schema)


def _chain(parts: DataFrame, kind: str) -> DataFrame:
    """Chunks of a conversation, in order -> its counts, cost and audit. A group has a row for each task at most."""
    some = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", *COUNTS, "first", "last", "ways"))).alias("chunks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for conv, chunks in zip(b.column("conv_id").to_pylist(), b.column("chunks"), strict=True):
                ways, total, last = None, dict.fromkeys(COUNTS, 0), None
                for chunk in chunks:
                    c = chunk.as_py()
                    for k in COUNTS:
                        total[k] += c[k]
                    total["illegal"] += last is not None and last + c["first"] not in LEGAL
                    last = c["last"]
                    own = {(w["s"], w["t"]): (w["cost"], w["audit"]) for w in c["ways"]}
                    ways = combine(ways, own) if ways else {k: v for k, v in own.items() if k[0] == FIRST}
                cost, audit = close(ways)
                rows.append(total | {"conv_id": conv, "cost": cost, "audit": audit})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("conv_id", b.schema.field("conv_id").type), *[(c, pa.int64()) for c in (*COUNTS, "cost")], ("audit", pa.string())]))

    return some.mapInArrow(run, f"conv_id {kind}, {', '.join(f'{c} long' for c in (*COUNTS, 'cost'))}, audit string")


def _streams(rows: DataFrame, audits: DataFrame, out: str, kind: str) -> DataFrame:
    """Conversations with their audits, read in order: their hash (out = "hash") or their repaired rows (out = "rows")."""
    heads = audits.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast(dict(rows.dtypes)["turn"]).alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(1).cast("long").alias("n"))
    both = heads.unionByName(rows.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", "n"))
    placed = both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "text").select("conv_id", "kind", "role", "text", "n")
    schema = f"conv_id {kind}, repaired_sha256 string" if out == "hash" else f"conv_id {kind}, pos long, role string, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv_type = None

        def events() -> Iterator[tuple]:
            nonlocal conv_type
            for b in batches:
                conv_type = b.schema.field("conv_id").type
                yield from zip(*(b.column(c).to_pylist() for c in ("conv_id", "kind", "role", "text", "n")), strict=True)

        stream = events()
        head = next(stream, None)
        while head:
            conv, _, _, audit, _ = head
            head = None

            def own() -> Iterator[tuple[str, str]]:
                nonlocal head
                for e in stream:
                    if e[1] == 0:
                        head = e
                        return
                    for _ in range(e[4]):
                        yield e[2], e[3]

            source = own()
            turns = repaired(source, audit)
            if out == "hash":
                yield pa.RecordBatch.from_pylist([{"conv_id": conv, "repaired_sha256": digest(turns)}], schema=pa.schema([("conv_id", conv_type), ("repaired_sha256", pa.string())]))
            else:
                for pos, (role, text) in enumerate(turns):
                    yield pa.RecordBatch.from_pylist([{"conv_id": conv, "pos": pos, "role": role, "text": text}],
                                                     schema=pa.schema([("conv_id", conv_type), ("pos", pa.int64()), ("role", pa.string()), ("text", pa.string())]))
            for _ in source:  # on to the next head
                pass

    return placed.mapInArrow(run, schema)


def _clean(table: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    return table.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit(" ")).alias("role"), F.coalesce(text_col, F.lit(" ")).alias("text"))


def repair(table: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation."""
    spark = table.sparkSession
    small_batches(spark)
    rows = _clean(table, conv_col, turn_col, role_col, text_col)
    kind = dict(rows.dtypes)["conv_id"]
    with temporary(spark):
        # What a conversation says twice is found by a join: a role and text that a third of its turns share is one row on the right.
        said = F.sha2(F.concat(F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("n")), F.lit(":"), F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
        counted = stage(_ordered(rows).withColumn("said", said), "conv-rows")
        turn = F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("turn"))
        first = counted.groupBy("said").agg(F.min(turn).alias("first"))
        marked = counted.join(first, "said").withColumn("is_first", F.col("first.turn").eqNullSafe(F.col("turn")))
        chunks = stage(_chunks(marked, kind), "conv-chunks")
        whole = chunks.where("sha is not null").select("conv_id", *COUNTS, F.col("ways")[0]["cost"].alias("cost"), F.col("ways")[0]["audit"].alias("audit"), F.col("sha").alias("repaired_sha256"))
        parts = stage(_chain(chunks.where("sha is null"), kind), "conv-chained")
        ids = small(parts.select(F.col("conv_id").alias("open_id")))
        rest = counted.join(ids, F.col("conv_id").eqNullSafe(F.col("open_id")), "left_semi")
        hashes = _streams(rest, parts.select("conv_id", "audit"), "hash", kind).withColumnRenamed("conv_id", "hash_id")
        long = parts.join(hashes, F.col("conv_id").eqNullSafe(F.col("hash_id"))).select(*whole.columns)
        gaps = counted.groupBy(F.col("conv_id").alias("gap_id")).agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long").alias("gaps"))
        report = whole.unionByName(long).join(gaps, F.col("conv_id").eqNullSafe(F.col("gap_id")))
        return stage(report.select("conv_id", "gaps", *COUNTS, "cost", "audit", "repaired_sha256"), "conv-report", keep=True)


def repaired_rows(table: DataFrame, report: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, pos (from 0), role, text of the repaired conversations; report: what `repair` returned for the table."""
    rows = _clean(table, conv_col, turn_col, role_col, text_col)
    return _streams(_ordered(rows), report.select("conv_id", "audit"), "rows", dict(rows.dtypes)["conv_id"])


def damage(table: DataFrame) -> DataFrame:
    """The rows of conversations as op11's contract damages them, by a hash of conversation and turn."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = _clean(table, "conv_id", "turn", "role", "text").withColumn("way", F.crc32(key) % 20).where("way <> 0")
    text = F.when(F.col("way") == 1, "").when(F.col("way") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("way") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("way") == 3, 2).otherwise(1).alias("times"))
    return rows.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times", "time")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    report = repair(damage(table)).withColumnRenamed("conv_id", "id")
    every = table.select("conv_id").distinct()
    zero = F.lit(0).cast("long")
    out = every.join(report, F.col("conv_id").eqNullSafe(F.col("id")), "left")
    return out.select("conv_id", *[F.coalesce(c, zero).alias(c) for c in ("gaps", *COUNTS, "cost")], F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
