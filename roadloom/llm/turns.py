"""Repair of conversation structure: fault flags from windows, then the cheapest edits by a fold in Spark SQL.

The roles of a repaired conversation read `(s?(ua)+)?` by their initials, which four states recognise: nothing yet (0), after a
system turn (1), after a user turn (2), after an assistant turn (3). `aggregate` walks the sorted turns of a block and carries for each
state the cheapest (cost, audit) that ends there; `least` over structs settles ties by the audit's ASCII order.

A conversation of any length: turns are dealt out by ranges of their order, blocks of `BLOCK` turns are folded from each of the four
states, and the blocks' 4 x 4 tables are folded in the same way, `BLOCK` at a time, level by level; then the chosen states go
down again. So no task holds more than `BLOCK` turns (without texts) of one conversation. Only the digest of a repaired text is
sequential by nature: its turns stream through one hasher in order, a batch at a time.

Nulls: a null role or text counts as one space, null turns come first, a null id is a conversation of its own. Turns of one
number come by role, then by a hash of the text; equal rows are interchangeable. Very long texts are read whole; only the staged
turns and the streaming digest hold them. Columns other than the four are left aside, and their names don't matter. An
empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

#: Turns, or blocks of them, that one fold walks.
BLOCK = 256
#: A cost that no repair has: the state can't be reached.
FAR = 1 << 40
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
_SPACE = " \t\n\x0b\f\r"


def _entry(cost: Column, audit: Column) -> Column:
    return F.struct(cost.cast("long").alias("cost"), audit.alias("audit"))


def _four(entries: list[Column]) -> Column:
    return F.struct(*(e.alias(f"s{k}") for k, e in enumerate(entries)))


def _fold(items: Column, start: int, step) -> Column:
    """An array of the four (cost, audit) after all items, from the state `start`."""
    first = _four([_entry(F.lit(0 if k == start else FAR), F.lit("")) for k in range(4)])
    return F.aggregate(items, first, step, lambda acc: F.array(*(acc[f"s{k}"] for k in range(4))))


def _turn_step(acc: Column, x: Column) -> Column:
    """One turn (initial, must: it has to go, cut: it is truncated): delete it; or keep it or give it the role that the state
    asks for, with a turn inserted before it or not. Insertions before a deleted turn sort after those behind it."""
    extra = F.when(x["must"], F.lit(FAR)).otherwise(F.when(x["cut"], F.lit(CUT)).otherwise(F.lit(0)))

    def go(state: int, cost: Column, letters: Column) -> Column:
        own = acc[f"s{state}"]
        return _entry(own["cost"] + cost, F.concat(own["audit"], letters))

    def drop(state: int) -> Column:
        return go(state, F.lit(DELETE), F.lit("D"))

    def serve(state: int, initial: str, inserted: bool) -> Column:
        fits = x["initial"] == initial
        letter, cost = F.when(fits, F.lit("K")).otherwise(F.lit("R")), F.when(fits, F.lit(KEEP)).otherwise(F.lit(REROLE)) + extra
        return go(state, cost + INSERT, F.concat(F.lit("I"), letter)) if inserted else go(state, cost, letter)

    system = go(0, F.when(x["initial"] == "s", extra).otherwise(F.lit(FAR)), F.lit("K"))
    return _four([
        drop(0),
        F.least(drop(1), system),
        F.least(drop(2), *(serve(k, "u", False) for k in (0, 1, 3)), serve(2, "u", True)),
        F.least(drop(3), serve(2, "a", False), *(serve(k, "a", True) for k in (0, 1, 3))),
    ])


def _block_step(acc: Column, x: Column) -> Column:
    """One block by its table: from each state to each, its audits in order as digits."""

    def over(k: int, end: int) -> Column:
        way = x["ways"][k][end]
        return _entry(acc[f"s{k}"]["cost"] + way["cost"], F.concat(acc[f"s{k}"]["audit"], way["rank"]))

    return _four([F.least(*(over(k, end) for k in range(4))) for end in range(4)])


def _ranked(ways: Column) -> Column:
    """The table with each audit's rank among those of the same start: all that blocks further on need to know. Audits of one
    start and block are no prefixes of each other, so what follows can't turn their order."""

    def row(ends: Column) -> Column:
        smaller = lambda e: F.size(F.filter(ends, lambda o: (o["cost"] < FAR) & (o["audit"] < e["audit"])))
        return F.transform(ends, lambda e: F.struct(F.least(e["cost"], F.lit(FAR)).alias("cost"), F.when(e["cost"] < FAR, smaller(e).cast("string")).otherwise(F.lit("9")).alias("rank")))

    return F.transform(ways, row)


def _sorted_turns(turns: DataFrame) -> DataFrame:
    """id, conv, turn, role, text, print (the text's digest), blank, truncated: all turns in order of id, staged."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit(" ")), F.coalesce(F.col("text").cast("string"), F.lit(" "))
    rows = turns.select(F.col("conv_id").alias("conv"), "turn", role.alias("role"), text.alias("text")).withColumn("mix", F.xxhash64("text"))
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("mix").asc()]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id())
    last = F.substring(F.rtrim(F.col("text"), F.lit(_SPACE)), -1, 1)
    return stage(rows.select("id", "conv", "turn", "role", "text", F.sha2("text", 256).alias("print"), (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("truncated")), "turns")


def _flagged(turns: DataFrame) -> DataFrame:
    """id, conv, initial, fault ('' if none): a turn is a duplicate if its role and text stand earlier. The window is first kept
    within the range that a turn was dealt to, and then over one turn a range, so that a turn repeated without end
    fills no task."""
    key = ["conv", "role", "print"]
    rows = turns.select("id", *key, "blank", "truncated").withColumn("part", F.shiftright("id", 33))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*key, "part").orderBy("id")))
    rows = rows.withColumn("alone", F.when(F.col("nth") > 1, F.col("id")))
    again = (F.col("nth") > 1) | (F.col("id") > F.min("id").over(Window.partitionBy(*key, "alone")))
    fault = F.when(F.col("blank"), F.lit("blank")).when(again, F.lit("duplicate")).when(F.col("truncated"), F.lit("truncated")).otherwise(F.lit(""))
    return rows.select("id", "conv", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))


def _same(a: str, b: str) -> Column:
    return F.col(f"a.{a}").eqNullSafe(F.col(f"b.{b}"))


def _blocks(flagged: DataFrame) -> DataFrame:
    """conv, k (its number in the conversation), turns, ways."""
    item = F.struct("id", "initial", F.col("fault").isin("blank", "duplicate").alias("must"), (F.col("fault") == "truncated").alias("cut"))
    own = flagged.groupBy("conv", F.expr(f"id div {BLOCK}").alias("block")).agg(F.sort_array(F.collect_list(item)).alias("turns"))
    own = stage(own.withColumn("ways", F.array(*(_fold(F.col("turns"), k, _turn_step) for k in range(4)))), "turn-blocks")
    place = own.select("conv", "block", (F.row_number().over(Window.partitionBy("conv").orderBy("block")) - 1).cast("long").alias("k"))
    return own.alias("a").join(place.alias("b"), _same("conv", "conv") & (F.col("a.block") == F.col("b.block"))).select("a.conv", "b.k", "a.turns", "a.ways")


def _above(nodes: DataFrame) -> DataFrame:
    """conv, k, parts, ways of the next level: BLOCK nodes of a conversation in one."""
    part = F.struct("k", _ranked(F.col("ways")).alias("ways"))
    up = nodes.groupBy("conv", F.expr(f"k div {BLOCK}").alias("up")).agg(F.sort_array(F.collect_list(part)).alias("parts"))
    return up.select("conv", F.col("up").alias("k"), "parts", F.array(*(_fold(F.col("parts"), k, _block_step) for k in range(4))).alias("ways"))


def _ends(node: DataFrame) -> DataFrame:
    """conv, k, start, end, cost: from nothing to the best end, turns inserted there included."""
    closing = (KEEP, 2 * INSERT, INSERT, KEEP)
    ways = _ranked(F.col("ways"))[0]
    best = F.least(*(F.struct((ways[t]["cost"] + closing[t]).alias("cost"), ways[t]["rank"].alias("rank"), F.lit(t).alias("end")) for t in range(4)))
    return node.select("conv", "k", F.lit(0).alias("start"), best.alias("best")).select("conv", "k", "start", F.col("best.end").alias("end"), F.col("best.cost").alias("cost"))


def _down(nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    """conv, k, start, end of the parts of nodes whose start and end are chosen."""
    both = nodes.alias("a").join(chosen.alias("b"), _same("conv", "conv") & (F.col("a.k") == F.col("b.k"))).select("a.conv", "parts", "start", F.expr("ways[start][end].audit").alias("digits"))
    step = """aggregate(sequence(0, size(parts) - 1), named_struct('state', start, 'path', cast(array() as array<struct<k: bigint, start: int, end: int>>)),
        (acc, i) -> transform(filter(sequence(0, 3), t -> parts[i].ways[acc.state][t].rank = substring(digits, i + 1, 1) and parts[i].ways[acc.state][t].cost < {far}),
            t -> named_struct('state', t, 'path', concat(acc.path, array(named_struct('k', parts[i].k, 'start', acc.state, 'end', t)))))[0], acc -> acc.path)"""
    return both.select("conv", F.explode(F.expr(step.format(far=FAR))).alias("p")).select("conv", "p.k", "p.start", "p.end")


def _edits(blocks: DataFrame, chosen: DataFrame) -> DataFrame:
    """id, edit (K, R, D; after an I if a turn is inserted before it), before (that turn's role), given (an R's role)."""
    both = blocks.alias("a").join(chosen.alias("b"), _same("conv", "conv") & (F.col("a.k") == F.col("b.k"))).select("turns", "start", F.expr("ways[start][end].audit").alias("audit"))
    both = both.withColumn("edits", F.expr("regexp_extract_all(audit, '(I?[KRD])', 1)"))
    asked = "if({0} = 2, 'assistant', 'user')"
    after = "if({0} = 2, 3, 2)"
    inner = f"if(edits[i] like 'I_', {after.format('acc.state')}, acc.state)"
    state = f"case right(edits[i], 1) when 'D' then {inner} when 'R' then {after.format(inner)} else case turns[i].initial when 's' then 1 when 'u' then 2 else 3 end end"
    row = f"named_struct('id', turns[i].id, 'edit', edits[i], 'before', if(edits[i] like 'I_', {asked.format('acc.state')}, null), 'given', if(right(edits[i], 1) = 'R', {asked.format(inner)}, null))"
    walk = f"""aggregate(sequence(0, size(turns) - 1), named_struct('state', start, 'out', cast(array() as array<struct<id: bigint, edit: string, before: string, given: string>>)),
        (acc, i) -> named_struct('state', {state}, 'out', concat(acc.out, array({row}))), acc -> acc.out)"""
    return both.select(F.explode(F.expr(walk)).alias("e")).select("e.id", "e.edit", "e.before", "e.given")


class Repair:
    """The cheapest repair of the conversations `turns` (conv_id, turn, role, text):
    faults    conv, gaps, blank, duplicate, truncated
    costs     conv, end (the state that its own turns end in), cost
    edited    id, conv, role, text, edit, before, given: every turn with what becomes of it, in order of id"""

    def __init__(self, turns: DataFrame):
        self.turns = _sorted_turns(turns)
        flagged = stage(_flagged(self.turns), "turn-faults")
        levels = [stage(_blocks(flagged), "turn-places")]
        while levels[-1].where("k > 0").head(1):
            levels.append(stage(_above(levels[-1]), "turn-levels"))
        top = stage(_ends(levels[-1]), "turn-ends")
        chosen = top.select("conv", "k", "start", "end")
        for nodes in levels[:0:-1]:
            chosen = stage(_down(nodes, chosen), "turn-states")
        self.costs = top.select("conv", "end", "cost")
        self.edited = self.turns.select("id", "conv", "role", "text").join(_edits(levels[0], chosen), "id")
        counts = flagged.groupBy("conv").agg(*(F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")))
        spans = self.turns.groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
        self.faults = counts.alias("a").join(spans.alias("b"), _same("conv", "conv")).select("a.conv", F.coalesce("b.gaps", F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated")

    def repaired(self) -> DataFrame:
        """conv_id, id, part, role, text, edit of the repaired turns, in order of id and part; what is inserted at a
        conversation's end has a null id."""
        role = F.coalesce("given", "role")
        own = F.when(~F.col("edit").endswith("D"), F.struct(F.lit(1).alias("part"), role.alias("role"), F.col("text"), F.substring("edit", -1, 1).alias("edit")))
        new = F.when(F.col("before").isNotNull(), F.struct(F.lit(0).alias("part"), F.col("before").alias("role"), F.lit("").alias("text"), F.lit("I").alias("edit")))
        inner = self.edited.select("conv", "id", F.explode(F.array_compact(F.array(new, own))).alias("t"))
        closing = F.expr("case end when 1 then array('user', 'assistant') when 2 then array('assistant') else cast(array() as array<string>) end")
        last = self.costs.select("conv", F.posexplode(closing).alias("part", "role")).select(F.col("conv").alias("conv_id"), F.lit(None).cast("long").alias("id"), "part", "role", F.lit("").alias("text"), F.lit("I").alias("edit"))
        return inner.select(F.col("conv").alias("conv_id"), "id", "t.part", "t.role", "t.text", "t.edit").union(last)

    def digests(self) -> DataFrame:
        """conv, illegal, audit, repaired_sha256: the turns of each conversation in order, streamed through one hasher."""
        conv = self.edited.schema["conv"].dataType.simpleString()
        rows = self.edited.alias("a").join(self.costs.alias("b"), _same("conv", "conv")).select("a.conv", "id", "role", "text", "edit", "before", "given", "end")
        rows = rows.repartition("conv").sortWithinPartitions("conv", "id")
        return rows.mapInArrow(_digest, f"conv {conv}, illegal long, audit string, repaired_sha256 string")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns in order, a row for each conversation as it ends."""
    legal, kind = {"su", "ua", "au"}, None
    now, out = None, []

    def close() -> tuple:
        add("user:" if end == 1 else None)
        add("assistant:" if end in (1, 2) else None)
        return now[0], illegal, "".join(audit) + {1: "II", 2: "I"}.get(end, ""), sha.hexdigest()

    def add(line: str | None) -> None:
        nonlocal some
        if line is not None:
            sha.update(("\n" + line if some else line).encode())
            some = True

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], kind), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.string()), pa.array([r[3] for r in out], pa.string())], ["conv", "illegal", "audit", "repaired_sha256"])

    for b in batches:
        kind = b.schema.field("conv").type
        for conv, role, text, edit, before, given, last in zip(*(b.column(c).to_pylist() for c in ("conv", "role", "text", "edit", "before", "given", "end"))):
            if now is None or now[0] != conv:
                if now is not None:
                    out.append(close())
                now, sha, audit, illegal, previous, some = (conv,), hashlib.sha256(), [], 0, None, False
            end = last
            initial = role[:1]
            illegal += previous is not None and previous + initial not in legal
            previous = initial
            audit.append(edit)
            add(None if before is None else before + ":")
            if edit[-1] != "D":
                add((given or role) + ":" + text)
        if out:
            yield batch()
            out = []
    if now is not None:
        out.append(close())
        yield batch()


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with every fifth turn or so damaged, by the crc32 of `conv_id:turn` modulo 20: 0 drops it, 1 empties its
    text, 2 takes out `.`, `!` and `?`, 3 doubles it, 4 makes it the user's. Null roles and texts become one space, as nulls do in
    the key."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", plain("role").alias("role"), plain("text").alias("text"), F.pmod(F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn")).cast("binary")), F.lit(20)).alias("kind"))
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.where("kind <> 0").select("conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), "kind")
    return rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select("conv_id", "turn", "role", "text")


def repair_digest(conversations: DataFrame) -> DataFrame:
    """One row for each conv_id of `conversations`: faults after `damage`, the cheapest repair's cost and audit, and the
    digest of the repaired turns."""
    fixed = Repair(damage(conversations))
    out = conversations.select("conv_id").distinct().alias("c")
    out = out.join(fixed.faults.alias("f"), F.col("c.conv_id").eqNullSafe(F.col("f.conv")), "left")
    out = out.join(fixed.costs.alias("t"), F.col("c.conv_id").eqNullSafe(F.col("t.conv")), "left")
    out = out.join(fixed.digests().alias("d"), F.col("c.conv_id").eqNullSafe(F.col("d.conv")), "left")
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c.split(".")[1])
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return out.select("c.conv_id", *(number(c) for c in ("f.gaps", "f.blank", "f.duplicate", "f.truncated", "d.illegal", "t.cost")), F.coalesce("d.audit", F.lit("")).alias("audit"), F.coalesce("d.repaired_sha256", empty).alias("repaired_sha256"))
