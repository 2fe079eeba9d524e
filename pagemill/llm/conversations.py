"""Conversation structure repair: a Spark SQL higher-order fold finds the cheapest edits that make user and assistant alternate.

Fault flags come from windows over the turns of a conversation. Its turns are then collected as sorted structs, and
aggregate() folds them, carrying four (cost, audit) structs, one for each state of the grammar of role initials:
nothing yet (n), after the system turn (s), after a user turn (u), after an assistant turn (a). A step takes the
native least() of what leads to a state; equal costs are told apart by the audit.

A conversation may hold most rows of a table. So CHUNK turns at most are collected at once, and are folded from each
state that they may begin in; a second fold strings chunks together. That one holds some 20 bytes a turn, no texts.
Texts are exchanged once, to the hash of the repaired conversation, which reads them in order as a stream of batches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import load, numbered, store

#: Turns that one fold takes.
CHUNK = 256
#: Costs of edits, and what a truncated turn costs that is not deleted.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Roles of the grammar's u and a, which rerole and insert give.
ROLES = {"u": "user", "a": "assistant"}
#: Over any cost: no way leads here.
NEVER = 1 << 50
STATES = "nsua"


def damage(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text) as (ck, conv_id, turn, role, text, copy), some of them broken by a checksum of conv_id:turn; nulls in ids, role and text become one space, a null turn stays."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", space("conv_id"), space("turn")).cast("binary")) % 20
    d = rows.select(space("conv_id").alias("ck"), "conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind_")).where("kind_ <> 0")
    text = F.when(F.col("kind_") == 1, "").when(F.col("kind_") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.sequence(F.lit(0), (F.col("kind_") == 3).cast("int")))
    return d.select("ck", "conv_id", "turn", F.when(F.col("kind_") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy"))


def _keyed(rows: DataFrame) -> DataFrame:
    """rows with dk, a digest of role and text: the order of a turn's rows, and what duplicates share."""
    return rows.withColumn("dk", F.unhex(F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256)))


def _then(at: str, letter: str, cost) -> str:
    return f"named_struct('c', {at}.c + {cost}, 'a', concat({at}.a, '{letter}'))"


def _closed(x: str) -> str:
    """A state after any inserts that help."""
    u = f"least({x}.u, {', '.join(_then(f'{x}.{k}', 'I', f'{INSERT}L') for k in 'nsa')})"
    return f"transform(array({u}), v -> named_struct('n', {x}.n, 's', {x}.s, 'u', v, 'a', least({x}.a, {_then('v', 'I', f'{INSERT}L')})))[0]"


def _step(z: str, t: str) -> str:
    """State z after turn t(i, gone, late): kept or given a role where the grammar goes on, or deleted."""
    late = f"if({t}.late, {TRUNCATED}L, 0L)"

    def ways(into: str, froms: str) -> str:
        kept = f"if(not {t}.gone and {t}.i = '{into}', least({', '.join(_then(f'{z}.{k}', 'K', late) for k in froms)}), null)" if len(froms) > 1 else f"if(not {t}.gone and {t}.i = '{into}', {_then(f'{z}.{froms}', 'K', late)}, null)"
        if into == "s":
            return kept
        given = [_then(f"{z}.{k}", "R", f"{REROLE}L + {late}") for k in froms]
        return f"{kept}, if(not {t}.gone, {given[0] if len(given) == 1 else f'least({chr(44).join(given)})'}, null)"

    gone = {k: _then(f"{z}.{k}", "D", f"{DELETE}L") for k in STATES}
    return f"named_struct('n', {gone['n']}, 's', least({gone['s']}, {ways('s', 'n')}), 'u', least({gone['u']}, {ways('u', 'nsa')}), 'a', least({gone['a']}, {ways('a', 'u')}))"


def _start(at: str) -> str:
    """The state of a fold that begins in the state numbered `at`."""
    return "named_struct(" + ", ".join(f"'{k}', named_struct('c', if({at} = {i}, 0L, {NEVER}L), 'a', '')" for i, k in enumerate(STATES)) + ")"


def _joined(x: str, m: str) -> str:
    """State x before a chunk, m[i] being what the chunk makes of state i: the state after it."""
    to = lambda k: ", ".join(f"if(get({m}, {i}) is null, null, named_struct('c', {x}.{f}.c + get({m}, {i}).{k}.c, 'a', concat({x}.{f}.a, get({m}, {i}).{k}.a)))" for i, f in enumerate(STATES))
    return "named_struct(" + ", ".join(f"'{k}', least({to(k)})" for k in STATES) + ")"


def flags(rows: DataFrame) -> DataFrame:
    """Narrow rows of damaged ones: (ck, turn, dk, place, chunk, i, blank, truncated, duplicate), place counting from 0 in a conversation."""
    space = r"[\x20\x09-\x0D]"
    narrow = _keyed(rows).select("ck", "turn", "dk", "copy", F.substring("role", 1, 1).alias("i"), ~F.col("text").rlike(rf"[^\x20\x09-\x0D]"), F.col("text").rlike(rf"[.!?]{space}*\z"))
    narrow = narrow.toDF("ck", "turn", "dk", "copy", "i", "blank", "ended")
    placed = numbered(narrow, ["ck"], ["turn", "dk", "copy"], "place", "turns").drop("copy").withColumn("chunk", F.floor(F.col("place") / CHUNK))
    placed = store(placed, "placed")
    # A turn seen before in its chunk is found by a window over the chunk; what earlier chunks hold, of the few conversations that have more than one.
    long = store(placed.where("chunk > 0").select("ck").distinct(), "long")
    held = store(placed.join(long, "ck", "left_semi").select("ck", "dk", "chunk").distinct(), "held")
    again = held.join(held.groupBy("ck", "dk").agg(F.min("chunk").alias("first")), ["ck", "dk"]).where("chunk > first").select("ck", "chunk", "dk", F.lit(True).alias("again"))
    dealt = placed.repartition("ck", "chunk").join(again, ["ck", "chunk", "dk"], "left")
    nth = F.row_number().over(Window.partitionBy("ck", "chunk", "dk").orderBy("place"))
    out = dealt.withColumn("seen", (nth > 1) | F.col("again").isNotNull())
    return out.select("ck", "turn", "place", "chunk", "i", "blank", (~F.col("blank") & F.col("seen")).alias("duplicate"), (~F.col("blank") & ~F.col("seen") & ~F.col("ended")).alias("truncated"))


def audits(flagged: DataFrame) -> DataFrame:
    """(ck, blank, duplicate, truncated, illegal, cost, audit) of each conversation of flags()."""
    before = F.lag("i").over(Window.partitionBy("ck", "chunk").orderBy("place"))
    legal = ["su", "ua", "au"]
    turn = F.struct("place", "i", (F.col("blank") | F.col("duplicate")).alias("gone"), F.col("truncated").alias("late"))
    count = lambda c: F.sum(F.col(c).cast("long")).alias(c)
    chunks = flagged.withColumn("illegal", before.isNotNull() & ~F.concat(before, "i").isin(*legal)).groupBy("ck", "chunk").agg(F.sort_array(F.collect_list(turn)).alias("turns"), *map(count, ("blank", "duplicate", "truncated", "illegal")))
    fold = f"transform(sequence(0, if(chunk = 0, 0, {len(STATES) - 1})), b -> aggregate(turns, {_start('b')}, (x, t) -> transform(array({_closed('x')}), z -> {_step('z', 't')})[0]))"
    chunks = chunks.withColumns({"ways": F.expr(fold), "first": F.get("turns.i", F.lit(0)), "last": F.element_at("turns.i", -1)}).drop("turns")
    chunks = store(chunks, "chunks")
    seam = F.lag("last").over(Window.partitionBy("ck").orderBy("chunk"))
    chunks = chunks.withColumn("illegal", F.col("illegal") + F.coalesce((~F.concat(seam, "first").isin(*legal)).cast("long"), F.lit(0)))
    per = chunks.groupBy("ck").agg(F.sort_array(F.collect_list(F.struct("chunk", "ways"))).alias("m"), *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")))
    whole = f"aggregate(m.ways, {_start('0')}, (x, w) -> {_joined('x', 'w')}, x -> transform(array({_closed('x')}), z -> least(z.n, z.a))[0])"
    return per.select("ck", "blank", "duplicate", "truncated", "illegal", F.expr(whole).alias("best")).select("ck", "blank", "duplicate", "truncated", "illegal", F.col("best.c").alias("cost"), F.col("best.a").alias("audit"))


class _Digest:
    """SHA-256 of a conversation that comes in several batches: edits done so far, and the last role's initial."""

    def __init__(self, ck: str, audit: str) -> None:
        self.ck, self.audit, self.at, self.last, self.sum, self.any = ck, audit, 0, "", hashlib.sha256(), False

    def _put(self, line: str) -> None:
        self.sum.update((("\n" if self.any else "") + line).encode())
        self.any = True

    def _give(self) -> str:
        self.last = "a" if self.last == "u" else "u"
        return ROLES[self.last]

    def inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self._put(f"{self._give()}:")
            self.at += 1

    def turn(self, role: str, text: str) -> None:
        self.inserts()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "K":
            self.last = role[:1]
            self._put(f"{role}:{text}")
        elif edit == "R":
            self._put(f"{self._give()}:{text}")

    def row(self) -> tuple[str, str]:
        self.inserts()
        return self.ck, self.sum.hexdigest()


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Over rows sorted by ck, that with the audit first: (ck, repaired_sha256). A batch holds a few turns, a conversation any number of batches."""
    now, cols = None, ["ck", "repaired_sha256"]
    for pdf in batches:
        done = []
        for ck, audit, role, text in zip(pdf["ck"], pdf["audit"], pdf["role"], pdf["text"], strict=True):
            if now is None or ck != now.ck:
                done += [now.row()] if now else []
                now = _Digest(ck, audit)
            else:
                now.turn(role, text)
        yield pd.DataFrame(done, columns=cols)
    if now:
        yield pd.DataFrame([now.row()], columns=cols)


def repair(conversations: DataFrame) -> DataFrame:
    """A row for each conv_id of conversations(conv_id, turn, role, text), null included: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, after damage().

    Turns go by turn (nulls first), rows of one turn by a digest of role and text. A turn's first fault counts: blank,
    seen before in the conversation, or truncated. gaps counts numbers that are missing between the least and the
    largest turn, nulls aside. Conversations of which no row is left have zeros, an empty audit and the hash of an
    empty text; an empty table gives no rows. Other columns are not read.
    """
    rows = damage(conversations.select("conv_id", "turn", "role", "text"))
    flagged = flags(rows)
    found = store(audits(flagged), "audits")
    turns = rows.where("turn is not null").groupBy("ck", "turn").agg(F.lit(1).alias("one")).groupBy("ck").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    texts = _keyed(rows).select("ck", F.lit(1).alias("kind"), "turn", "dk", "copy", F.lit(None).cast("string").alias("audit"), "role", "text")
    none = F.lit(None)
    heads = found.select("ck", F.lit(0).alias("kind"), none.cast(rows.schema["turn"].dataType).alias("turn"), none.cast("binary").alias("dk"), F.lit(0).alias("copy"), "audit", none.cast("string").alias("role"), none.cast("string").alias("text"))
    stream = texts.unionByName(heads).repartition("ck").sortWithinPartitions("ck", "kind", "turn", "dk", "copy").select("ck", "audit", "role", "text")
    hashes = stream.mapInPandas(_hashed, "ck string, repaired_sha256 string")
    ids = conversations.groupBy("conv_id").agg(F.lit(1).alias("one")).select("conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("ck"))
    out = ids.join(found, "ck", "left").join(turns, "ck", "left").join(hashes, "ck", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select("conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    """op13: repair() of the whole table conversations."""
    return repair(load(spark, sf_dir, "conversations"))


def _ways(letter: str, cost: str, *froms: str) -> str:
    return ", ".join(f"{{'c': {f}.c + {cost}, 'a': {f}.a || '{letter}'}}" for f in froms)


_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda ch: ascii(ch)::BIGINT)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
#: The fold as a recursion over places; the checksum bit by bit.
ORACLE = rf"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') AS ck, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
b AS (SELECT *, {_CRC} % 20 AS kind FROM k),
d AS (SELECT ck, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(1 + (kind = 3)::INT)) AS copy FROM b WHERE kind <> 0),
p AS (SELECT *, row_number() OVER (PARTITION BY ck ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || ':' || text), copy) - 1 AS place FROM d),
f AS (SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, row_number() OVER (PARTITION BY ck, role, text ORDER BY place) > 1 AS seen, substr(role, 1, 1) AS i, lag(substr(role, 1, 1)) OVER (PARTITION BY ck ORDER BY place) AS before FROM p),
g AS (SELECT *, bare = '' AS blank, bare <> '' AND seen AS duplicate, bare <> '' AND NOT seen AND right(bare, 1) NOT IN ('.', '!', '?') AS truncated FROM f),
fold AS (
  SELECT ck, 0::BIGINT AS j, {{'c': 0::BIGINT, 'a': ''}} AS n, {{'c': {NEVER}::BIGINT, 'a': ''}} AS s, {{'c': {NEVER}::BIGINT, 'a': ''}} AS u, {{'c': {NEVER}::BIGINT, 'a': ''}} AS a FROM (SELECT DISTINCT ck FROM k)
  UNION ALL
  SELECT ck, j + 1, {_ways('D', '2', 'n')}, least({_ways('D', '2', 's')}, CASE WHEN NOT gone AND i = 's' THEN {_ways('K', 'late', 'n')} END),
    least({_ways('D', '2', 'u')}, CASE WHEN NOT gone AND i = 'u' THEN least({_ways('K', 'late', 'n', 's', 'a')}) END, CASE WHEN NOT gone THEN least({_ways('R', '1 + late', 'n', 's', 'a')}) END),
    least({_ways('D', '2', 'a')}, CASE WHEN NOT gone AND i = 'a' THEN {_ways('K', 'late', 'u')} END, CASE WHEN NOT gone THEN {_ways('R', '1 + late', 'u')} END)
  FROM (SELECT ck, j, n, s, u, least(a, {_ways('I', '5', 'u')}) AS a, i, gone, late FROM (SELECT fold.ck, j, n, s, least(u, {_ways('I', '5', 'n', 's', 'a')}) AS u, a, i, blank OR duplicate AS gone, 5 * truncated::BIGINT AS late FROM fold JOIN g ON g.ck = fold.ck AND place = j))),
ends AS (SELECT ck, least(n, a, {_ways('I', '5', 'u')}, {_ways('II', '10', 'n', 's')}) AS best FROM fold WHERE j = (SELECT count(*) FROM g WHERE g.ck = fold.ck)),
edits AS (SELECT ck, unnest(string_split(best.a, '')) AS e, unnest(range(length(best.a))) AS pos FROM ends),
rows_ AS (SELECT *, count(*) FILTER (e <> 'I') OVER (PARTITION BY ck ORDER BY pos) - 1 AS place FROM edits),
put AS (SELECT r.ck, pos, e, role, coalesce(text, '') AS text, row_number() OVER w AS nth, first_value(i = 's' AND e = 'K') OVER w AS led FROM rows_ r LEFT JOIN g ON g.ck = r.ck AND g.place = r.place AND e <> 'I' WHERE e <> 'D' WINDOW w AS (PARTITION BY r.ck ORDER BY pos)),
lines AS (SELECT ck, string_agg(CASE WHEN e = 'K' THEN role WHEN (nth - coalesce(led, false)::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY pos) AS whole FROM put GROUP BY 1),
sums AS (SELECT ck, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated, count(*) FILTER (before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY 1)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, best.c AS cost, best.a AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, ck FROM k) JOIN ends USING (ck) LEFT JOIN sums USING (ck) LEFT JOIN lines USING (ck)
"""
