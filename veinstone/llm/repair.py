"""Repair of the order of turns in conversations by error-correcting Earley parsing.

A weighted grammar says which sequences of roles a conversation may have. Its terminals
also have error productions: a row may be deleted, it may be read as another role, and an
empty turn may be inserted. The chart holds items (rule, dot), each with the least
(cost, audit) that reaches it; the audit lists the edits by their initials (Delete,
Insert, Keep, Rerole). The completed chart gives the cheapest repair.

The grammar is left-linear (a nonterminal stands only first in a rule), so that every item
starts at the first row and completion asks the first column alone. Two columns of the
chart are therefore held, whatever the length of a conversation. The digest of the repaired
text travels with each item, and the part of the audit that all items share is put by.

Rows are dealt by conversation and come to a task sorted, in a stream; what one
conversation needs does not grow with it (except its audit, a character a row). One
conversation is read by one task, because its result is one digest over its rows in order.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veinstone.llm.text import give_back, sliced_by_bytes
from veinstone.llm.variants import CRC32, crc32_of

BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
WHITE = " \t\n\x0b\x0c\r"
LEGAL_PAIRS = frozenset({"su", "ua", "au"})


@dataclass(frozen=True)
class Grammar:
    """Rules (left side, right side); a symbol of a right side that is no left side is the
    initial of a role. ``roles``: what may be inserted or read instead. ``slack``: how much more
    the cheapest end from one item can cost than from another; dearer items are dropped."""

    rules: tuple[tuple[str, tuple[str, ...]], ...]
    start: str
    roles: tuple[tuple[str, str], ...]
    rerole: int = 3
    delete: int = 4
    insert: int = 3
    truncated: int = 3
    slack: int | None = None

    def __post_init__(self) -> None:
        left = {a for a, _ in self.rules}
        if self.start not in left or any(x in left for _, body in self.rules for x in body[1:]):
            raise ValueError("a nonterminal may stand only first in a rule")


#: (s?(ua)+)? - S: a conversation, T: one that ends with an answer, P: with a question, Q: before a question.
#: Slack: from any item, two inserted turns reach any other, and a system turn may have to be deleted.
ROLES = Grammar(
    rules=(("S", ()), ("S", ("T",)), ("T", ("P", "a")), ("P", ("Q", "u")), ("Q", ()), ("Q", ("s",)), ("Q", ("T",))),
    start="S", roles=(("u", "user"), ("a", "assistant")), slack=10,
)


class Chart:
    """The chart of one conversation, row by row. An item's value: cost, audit since the shared
    part, digest of the repaired text, and text that is still to be added to it."""

    def __init__(self, grammar: Grammar) -> None:
        self.g = grammar
        self.roles = dict(grammar.roles)
        left = {a for a, _ in grammar.rules}
        self.waiting: dict[str, list[tuple[int, int]]] = {}
        self.next: dict[tuple[int, int], str | None] = {}  # the terminal after the dot; None: complete
        for k, (_, body) in enumerate(grammar.rules):
            if body and body[0] in left:
                self.waiting.setdefault(body[0], []).append((k, 1))
            for dot in range(1 if body and body[0] in left else 0, len(body) + 1):
                self.next[k, dot] = body[dot] if dot < len(body) else None
        self.shared: list[str] = []
        self.rows = 0
        none = (0, "", None, "")
        self.column = self._close({item: none for item in self.next if item[1] == 0})

    def _close(self, column: dict) -> dict:
        """Completions and inserted turns, until no item gets cheaper; then digests."""
        todo = list(column)
        while todo:
            item = todo.pop()
            cost, audit, digest, tail = column[item]
            symbol = self.next[item]
            if symbol is None:
                reached = [(to, column[item]) for to in self.waiting.get(self.g.rules[item[0]][0], ())]
            elif symbol in self.roles:
                reached = [((item[0], item[1] + 1), (cost + self.g.insert, audit + "I", digest, f"{tail}\n{self.roles[symbol]}:"))]
            else:
                continue
            for to, value in reached:
                if to not in column or value[:2] < column[to][:2]:
                    column[to] = value
                    todo.append(to)
        start = {k for k, (a, _) in enumerate(self.g.rules) if a == self.g.start}
        live = {item: v for item, v in column.items() if self.next[item] is not None or item[0] in start}
        if self.g.slack is not None:
            most = min(v[0] for v in live.values()) + self.g.slack
            live = {item: v for item, v in live.items() if v[0] <= most}
        return {item: (cost, audit, _added(digest, tail), "") for item, (cost, audit, digest, tail) in live.items()}

    def read(self, role: str, text: str, fault: int) -> None:
        g, column = self.g, {}

        def put(to: tuple[int, int], value: tuple) -> None:
            if to not in column or value[:2] < column[to][:2]:
                column[to] = value

        more = g.truncated if fault == TRUNCATED else 0
        for item, (cost, audit, digest, _) in self.column.items():
            put(item, (cost + g.delete, audit + "D", digest, ""))
            symbol = self.next[item]
            if symbol is None or fault in (BLANK, DUPLICATE):
                continue
            if symbol == role[:1]:
                put((item[0], item[1] + 1), (cost + more, audit + "K", digest, f"\n{role}:{text}"))
            elif symbol in self.roles:
                put((item[0], item[1] + 1), (cost + more + g.rerole, audit + "R", digest, f"\n{self.roles[symbol]}:{text}"))
        self.column = self._close(column)
        self.rows += 1
        if self.rows % 256 == 0 and (same := os.path.commonprefix([v[1] for v in self.column.values()])):
            self.shared.append(same)
            self.column = {item: (c, audit[len(same) :], d, t) for item, (c, audit, d, t) in self.column.items()}

    def end(self) -> tuple[int, str, str]:
        """Cost, audit and digest of the cheapest repair."""
        whole = [v for item, v in self.column.items() if self.next[item] is None and self.g.rules[item[0]][0] == self.g.start]
        cost, audit, digest, _ = min(whole, key=lambda v: v[:2])
        return cost, "".join([*self.shared, audit]), (digest or hashlib.sha256()).hexdigest()


def _added(digest, text: str):
    """The digest of a text that goes on with ``text``; lines are set apart by newlines."""
    if not text:
        return digest
    digest, text = (hashlib.sha256(), text[1:]) if digest is None else (digest.copy(), text)
    digest.update(text.encode())
    return digest


class Conversation:
    """Counts and chart of one conversation."""

    def __init__(self, conv_id, grammar: Grammar) -> None:
        self.conv_id, self.chart = conv_id, Chart(grammar)
        self.faults = [0, 0, 0, 0]
        self.illegal = self.turns = 0
        self.low = self.high = self.before = None

    def read(self, turn: int | None, role: str, text: str, fault: int) -> None:
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high, self.turns = turn, self.turns + 1
        self.illegal += self.before is not None and self.before + role[:1] not in LEGAL_PAIRS
        self.before = role[:1]
        self.faults[fault] += 1
        self.chart.read(role, text, fault)

    def result(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.conv_id, gaps, *self.faults[1:], self.illegal, *self.chart.end()


def with_faults(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, fault, gone: dealt by conversation and sorted in each task by
    conversation and turn, null first, then role and text. A row equal to an earlier one in
    role and text is found by a sort of its own, next to the first, so no table of texts is held."""
    gone = F.col("gone") if "gone" in turns.columns else F.lit(False)
    t = turns.select("conv_id", F.col("turn").cast("long"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")], gone.alias("gone"))
    earlier = Window.partitionBy("conv_id", "role", "text", "gone").orderBy(F.col("turn").asc_nulls_first())
    last = F.right(F.rtrim("text", F.lit(WHITE)), F.lit(1))
    t = t.repartition("conv_id").withColumn("again", F.row_number().over(earlier) > 1)
    fault = F.when(last == "", BLANK).when(F.col("again"), DUPLICATE).when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(0)
    t = t.sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text", "again")])  # of equal rows the first comes first
    return t.select("conv_id", "turn", "role", "text", fault.alias("fault"), "gone")


def repair(turns: DataFrame, grammar: Grammar = ROLES) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every
    conversation of ``turns`` (conv_id, turn, role, text).

    Rows go by turn, nulls first, ties by role and text; a null role or text is one space; a
    null conv_id is one conversation; repeated rows are rows, of which all but the first are
    duplicates; an empty table gives no rows; texts are taken whole. Rows whose optional column
    ``gone`` is true only say that the conversation exists. Other columns are ignored."""
    kind = dict(turns.dtypes)["conv_id"]
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    schema = f"conv_id {kind}, {', '.join(f'{c} long' for c in counts)}, audit string, repaired_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Conversation | None = None
        done: list[tuple] = []
        types = None
        for batch in sliced_by_bytes(batches, 3):
            types = [batch.column(0).type, *[pa.int64()] * len(counts), pa.string(), pa.string()]
            for conv_id, turn, role, text, fault, gone in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if now is None or conv_id != now.conv_id:
                    if now is not None:
                        done.append(now.result())
                    now = Conversation(conv_id, grammar)
                if not gone:
                    now.read(turn, role, text, fault)
            if done:
                yield _batch(done, types)
                done = []
        if now is not None:
            yield _batch([*done, now.result()], types)
        give_back()

    def _batch(rows: list[tuple], types: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["conv_id", *counts, "audit", "repaired_sha256"])

    return with_faults(turns).mapInArrow(run, schema)


def repaired_turns(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 1), role, text, edit of the repaired conversations by ``ROLES``.

    An edit takes the next row, but for an inserted one. After a system turn that is kept first,
    questions and answers take turns, so the place tells the role that was read or inserted."""
    order = Window.partitionBy("conv_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edits = repair(turns).select("conv_id", F.posexplode(F.split("audit", "")).alias("seq", "edit")).where("edit <> ''")
    edits = edits.withColumns({"k": F.sum((F.col("edit") != "I").cast("long")).over(order), "place": F.sum((F.col("edit") != "D").cast("long")).over(order)}).where("edit <> 'D'")
    by = Window.partitionBy("conv_id").orderBy(*[F.col(c).asc_nulls_first() for c in ("turn", "role", "text")])
    rows = turns.where(~F.col("gone")) if "gone" in turns.columns else turns
    rows = rows.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    rows = rows.select(F.col("conv_id").alias("_conv"), F.row_number().over(by).cast("long").alias("_k"), "role", "text")
    both = edits.join(rows, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("k") == F.col("_k")) & (F.col("edit") != "I"), "left")
    system = F.max((F.col("place") == 1) & (F.col("edit") == "K") & F.col("role").startswith("s")).over(Window.partitionBy("conv_id"))
    named = F.when((F.col("place") + F.coalesce(system, F.lit(False)).cast("int")) % 2 == 1, "user").otherwise("assistant")
    return both.select("conv_id", "place", F.when(F.col("edit") == "K", F.col("role")).otherwise(named).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "edit")


def damage(turns: DataFrame) -> DataFrame:
    """Rows with faults by the crc32 of ``conv_id:turn``, a twentieth each: dropped (kept with
    ``gone``), emptied, without sentence marks, repeated, given to the user. Nulls are one space."""
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    t = turns.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")], (F.crc32(name) % 20).alias("hit"))
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    t = t.select(
        "conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("hit") == 0).alias("gone"),
        F.explode(F.when(F.col("hit") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    )
    return t.drop("copy")


#: The states are: 0 nothing kept, 1 after a system turn, 2 after a question, 3 after an answer. In each step up to two
#: turns are inserted (three come back to a state), then the row is deleted, kept or read as another role.
ORACLE = rf"""
WITH RECURSIVE {CRC32}, r AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
  FROM conversations
), h AS (
  SELECT conv_id, turn, role, text, {crc32_of("name")} % 20 AS hit FROM r, tab
), d AS (
  SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
    CASE hit WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN hit = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM h WHERE hit <> 0
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last
  FROM d
), f AS (
  SELECT *, left(role, 1) AS c, CASE WHEN last = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN last NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM o
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
    count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (before IS NOT NULL AND before || c NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM f GROUP BY conv_id
), ins(state, reached, k) AS (
  VALUES (0, 0, 0), (1, 1, 0), (2, 2, 0), (3, 3, 0), (0, 2, 1), (1, 2, 1), (2, 3, 1), (3, 2, 1), (0, 3, 2), (1, 3, 2)
), act(state, want, reached) AS (
  VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)
), steps AS (
  SELECT ins.state, ins.k, ins.reached AS mid, CAST(NULL AS VARCHAR) AS want, ins.reached FROM ins
  UNION ALL SELECT ins.state, ins.k, ins.reached, act.want, act.reached FROM ins JOIN act ON ins.reached = act.state
), walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS state, CAST(0 AS BIGINT) AS cost, '' AS audit, '' AS made FROM counts
  UNION ALL
  SELECT conv_id, i, state, cost, audit, made FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, audit) AS best FROM (
    SELECT w.conv_id, f.i, s.reached AS state,
      w.cost + 3 * s.k + CASE WHEN s.want IS NULL THEN 4 ELSE CASE WHEN f.fault = 3 THEN 3 ELSE 0 END + CASE WHEN s.want = f.c THEN 0 ELSE 3 END END AS cost,
      w.audit || repeat('I', s.k) || CASE WHEN s.want IS NULL THEN 'D' WHEN s.want = f.c THEN 'K' ELSE 'R' END AS audit,
      w.made || CASE WHEN s.k = 0 THEN '' WHEN s.k = 1 THEN chr(10) || CASE s.mid WHEN 2 THEN 'user:' ELSE 'assistant:' END ELSE chr(10) || 'user:' || chr(10) || 'assistant:' END
        || CASE WHEN s.want IS NULL THEN '' ELSE chr(10) || CASE WHEN s.want = f.c THEN f.role WHEN s.want = 'u' THEN 'user' ELSE 'assistant' END || ':' || f.text END AS made
    FROM walk w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1
      JOIN steps s ON s.state = w.state AND (s.want IS NULL OR f.fault IN (0, 3) AND (s.want = f.c OR s.want <> 's'))
  )) WHERE best = 1
), ends AS (
  SELECT w.conv_id, w.cost + 3 * ins.k AS cost, w.audit || repeat('I', ins.k) AS audit,
    w.made || CASE WHEN ins.k = 0 THEN '' WHEN ins.k = 1 THEN chr(10) || 'assistant:' ELSE chr(10) || 'user:' || chr(10) || 'assistant:' END AS made
  FROM walk w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.i
    JOIN ins ON ins.state = w.state AND (ins.reached = 3 OR ins.reached = 0)
), best AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) AS k FROM ends
)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(made[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counts c ON a.conv_id IS NOT DISTINCT FROM c.conv_id
  LEFT JOIN best b ON a.conv_id IS NOT DISTINCT FROM b.conv_id AND b.k = 1
"""
