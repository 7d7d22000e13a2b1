"""Repair of conversations whose turns are damaged, at least cost, as a fold over each conversation's rows.

Rows are taken by turn, nulls first; rows of one turn by role, then text (byte order). Null roles and texts count as
one space. A row's first fault counts: blank (no character but white space), duplicate (role and text of an earlier
row), truncated (its last character that is no white space isn't one of . ! ?). A repair keeps rows (0), gives them
the role user or assistant (2), deletes them (3; blank and duplicate rows must go) and inserts empty turns (2), each
truncated row that stays adds 1; the initials of its roles read (s?(ua)+)?. Of the cheapest repairs the one whose
audit (initials of its edits, in order) comes first in ASCII order is taken; state and edit tell the role, so an audit
is one repair. A role without a character, or with another initial than s, u and a, can't be kept.

Rows with a null conversation id are one conversation; rows without a turn have no part in gaps. Repeated rows are
duplicates of each other. An empty table gives an empty result; only the four columns are read, so extra ones do no
harm. A conversation is one row of the result, with its audit and repaired text, and so is one task's work; the fold
carries short strings (BLOCK rows of edits), so its time doesn't grow with the square of the rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

VISIBLE = r"[^\x20\x09-\x0D]"
CUT_OFF = r"[^\x20\x09-\x0D.!?][\x20\x09-\x0D]*\z"
RELABEL, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Rows whose edits are folded before they are joined to those of the rows before.
BLOCK = 256
#: What has been given so far: nothing, a system turn, ..., a user turn, ..., an assistant turn.
STATES = ("start", "system", "user", "assistant")
IMPOSSIBLE = 1 << 40


def _with(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x evaluated once."""
    return F.transform(F.array(x), f)[0]


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role and text after damage by crc32(conv_id:turn) % 20, and lost: the rows that it drops, which stay
    so that no conversation vanishes."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), (F.crc32(key) % 20).alias("code"))
    code = F.col("code")
    rows = rows.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.when(code == 3, 2).otherwise(1))))
    text = F.when(code == 1, "").when(code == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(code == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (code == 0).alias("lost"))


def faults(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text, lost) with place (from 1, by turn), initial, blank, duplicate, truncated, illegal (its
    initial can't follow that of the row before) and new_turn."""
    by_turn = Window.partitionBy("conv_id", "lost").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    same = Window.partitionBy("conv_id", "lost", "role", "text").orderBy("place")
    rows = rows.repartition("conv_id")  # one shuffle serves both windows and the fold
    rows = rows.withColumn("initial", F.substring("role", 1, 1))
    blank = ~F.col("text").rlike(VISIBLE)
    before = F.lag("initial").over(by_turn)
    last_turn = F.lag("turn").over(by_turn)
    rows = rows.withColumns({"place": F.row_number().over(by_turn), "before": before, "last_turn": last_turn})
    rows = rows.withColumn("seen", F.row_number().over(same) > 1)
    return rows.select(
        "conv_id", "turn", "role", "text", "lost", "place", "initial", blank.alias("blank"), (~blank & F.col("seen")).alias("duplicate"),
        (~blank & ~F.col("seen") & F.col("text").rlike(CUT_OFF)).alias("truncated"),
        (F.col("before").isNotNull() & ~F.concat("before", "initial").isin("su", "ua", "au")).alias("illegal"),
        (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("last_turn"))).alias("new_turn"),
    )


def _then(x: Column, edit: str, cost: Column | int) -> Column:
    return F.struct((x.cost + cost).cast("long").alias("cost"), x.rank.alias("rank"), F.concat(x.audit, F.lit(edit)).alias("audit"))


def _inserted(s: Column) -> Column:
    """The states after the inserts that may come next: a user turn opens a pair, an assistant turn ends it."""
    opened = F.least(s.user, *[_then(s[k], "I", INSERT) for k in ("start", "system", "assistant")])
    done = F.struct(s.start.alias("start"), s.system.alias("system"), opened.alias("user"), s.assistant.alias("assistant"))
    return _with(done, lambda o: o.withField("assistant", F.least(o.assistant, _then(o.user, "I", INSERT))))


def _step(s: Column, row: Column) -> Column:
    """The states after one more row: the cheapest way to each, as (cost, rank of the edits before the block, edits in it)."""
    extra = F.when(row.truncated, TRUNCATED).otherwise(0)
    stays = F.when(row.bad, F.lit(IMPOSSIBLE)).otherwise(extra)

    def kept(x: Column, initial: str) -> Column:
        return _then(x, "K", F.when(row.initial == initial, stays).otherwise(F.lit(IMPOSSIBLE)))

    def led(o: Column) -> Column:
        opener = F.least(o.start, o.system, o.assistant)
        return F.struct(
            _then(o.start, "D", DELETE).alias("start"),
            F.least(_then(o.system, "D", DELETE), kept(o.start, "s")).alias("system"),
            _with(opener, lambda p: F.least(_then(o.user, "D", DELETE), kept(p, "u"), _then(p, "R", stays + RELABEL))).alias("user"),
            F.least(_then(o.assistant, "D", DELETE), kept(o.user, "a"), _then(o.user, "R", stays + RELABEL)).alias("assistant"),
        )

    return _with(_inserted(s), led)


def _states(of: Callable[[str], Column]) -> Column:
    return F.struct(*[of(k).alias(k) for k in STATES])


def cheapest(rows: Column) -> Column:
    """(cost, audit) of the cheapest repair of rows, an array of structs with initial, bad and truncated.

    Every state after a row ends with that row's edit, so of two of them neither audit begins with the other: their ranks
    stand for them while a block is folded."""
    zero = F.lit(0).cast("long")
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(rows) - 1) / BLOCK).cast("int"))), lambda b: F.slice(rows, b * BLOCK + 1, F.lit(BLOCK)))
    begun = _states(lambda k: F.struct((zero if k == "start" else F.lit(IMPOSSIBLE).cast("long")).alias("cost"), F.lit("").alias("audit")))

    def ranked(s: Column, order: Column) -> Column:
        return _states(lambda k: F.struct(s[k].cost.alias("cost"), F.array_position(order, s[k].audit).cast("int").alias("rank"), F.lit("").alias("audit")))

    def folded(s: Column, block: Column) -> Column:
        def through(order: Column) -> Column:
            ends = F.aggregate(block, ranked(s, order), _step)
            return _with(ends, lambda e: _states(lambda k: F.struct(e[k].cost.alias("cost"), F.concat(F.element_at(order, e[k]["rank"]), e[k].audit).alias("audit"))))

        return _with(F.sort_array(F.array(*[s[k].audit for k in STATES])), through)

    def ended(s: Column) -> Column:
        last = _inserted(_states(lambda k: F.struct(s[k].cost.alias("cost"), F.lit(1).alias("rank"), s[k].audit.alias("audit"))))
        return _with(last, lambda o: F.least(o.start, o.assistant))

    return _with(F.aggregate(blocks, begun, folded), ended)


def repaired_turns(rows: Column, audit: Column) -> Column:
    """An array of (role, text): rows after the edits of audit."""
    none = F.struct(F.lit("I").alias("edit"), F.lit("").alias("role"), F.lit("").alias("text"))
    groups = F.regexp_extract_all(audit, F.lit("(I*[KRD]|I+)"), F.lit(1))

    def given(z: Column) -> Column:
        edit = F.right(z.g, F.lit(1))
        inserts = F.length(z.g) - F.when(edit == "I", 0).otherwise(1)
        row = F.when(edit.isin("K", "R"), F.array(F.struct(edit.alias("edit"), z.r.role.alias("role"), z.r.text.alias("text")))).otherwise(F.array().cast("array<struct<edit:string,role:string,text:string>>"))
        return F.concat(F.array_repeat(none, inserts), row)

    flat = F.flatten(F.transform(F.arrays_zip(groups.alias("g"), rows.alias("r")), given))
    leads = F.when((F.get(flat, F.lit(0)).edit == "K") & F.get(flat, F.lit(0)).role.startswith("s"), 1).otherwise(0)
    return _with(F.struct(flat.alias("flat"), leads.alias("leads")), lambda f: F.transform(
        f.flat, lambda x, i: F.struct(F.when(x.edit == "K", x.role).when((i - f.leads) % 2 == 0, "user").otherwise("assistant").alias("role"), x.text.alias("text"))))


def repair(rows: DataFrame) -> DataFrame:
    """A row for each conv_id of rows (conv_id, turn, role, text, and lost: true for rows that only name their conversation):
    gaps, blank, duplicate, truncated, illegal, cost, audit and turns, the repaired (role, text) in order."""
    found = faults(rows)
    stay = ~F.col("lost")
    turn = F.struct("place", "role", "text", "initial", (F.col("blank") | F.col("duplicate")).alias("bad"), "truncated")
    counts = {c: F.count_if(stay & F.col(c)).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")}
    held = F.when(stay, F.col("turn"))
    gaps = F.max(held).cast("long") - F.min(held).cast("long") + 1 - F.count_if(stay & F.col("new_turn"))
    kept = found.groupBy("conv_id").agg(F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"), *counts.values(), F.sort_array(F.collect_list(F.when(stay, turn))).alias("rows"))
    short = F.transform("rows", lambda r: F.struct(r.initial.alias("initial"), r.bad.alias("bad"), r.truncated.alias("truncated")))
    best = kept.withColumn("short", short).withColumn("best", cheapest(F.col("short")))
    return best.select("conv_id", "gaps", *counts, F.col("best.cost").alias("cost"), F.col("best.audit").alias("audit"), repaired_turns(F.col("rows"), F.col("best.audit")).alias("turns"))


def repaired_text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(t.role, F.lit(":"), t.text)), "\n")
