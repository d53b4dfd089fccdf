"""Quotation linking for chat messages, with DataFrame functions only.

A line's quote level is the number of ``>`` marks it opens with. Consecutive lines of one level from 1 on are a
quoted passage. Lines are normalised (marks and outer space dropped, white space collapsed, lower case) and hashed,
and a passage whole, as the sum of its lines' hashes and their sum weighted by place. A passage is linked when one
earlier message of the conversation says all of it in its order: as a run of neighbouring lines of its own words, blank
and quoted lines aside. Its original is the first message that does. A message replies to the latest original among its
passages of level 1, and always to an earlier turn. Following the replies gives its ``thread`` (the turn that the
discussion began with) and ``depth`` (how many replies lie between), so that (conv_id, thread, turn) puts every reply
behind what it answers. The body is the message without its quoted lines.

Only hashes are shuffled for linking. Own lines carry running sums, so the sums of any run are differences of two rows:
a run is looked at where its first line is the first line of a passage of its length, and costs the same however long
it is. What messages say is aggregated to one row per (conversation, run) before it meets the passages, so that a run
that many messages repeat or quote never pairs up with itself. Threads are found by doubling the steps, in as many
rounds as the depth has binary digits.

Defined results: a null text is an empty body without quotes; blank quoted lines belong to their passage but need no
original, and a passage of blank lines only is no passage; messages without conv_id or turn keep their body, link to
nothing and are their own thread; repeated rows each get their row; rows that share conv_id and turn but not a text are
apart, and who replies to that turn continues the latest of their threads' originals. Of equal originals the earliest
turn counts. Messages of any length are taken whole. Extra columns, whatever their names, are not read. An empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skillweave.llm.common import written

#: Copies of the passages' first lines that share the messages of a conversation.
SALTS = 16
#: Hashes in sums: small enough that a message of any length fits into 38 digits.
_HASH = (1 << 52) - 1
_MARKS = r"^([ \t]*>)*[ \t]*"
_MESSAGE = ["conv_id", "turn", "row_key"]


def _level(line):
    marks = F.regexp_extract(line, _MARKS, 0)
    return F.length(marks) - F.length(F.replace(marks, F.lit(">")))


def _said(line):
    words = F.substr(line, F.length(F.regexp_extract(line, _MARKS, 0)) + 1)
    return F.lower(F.trim(F.regexp_replace(words, r"\s+", " ")))


def _exact(number):
    return number.cast("decimal(38,0)")


def lines_of(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, row_key, at, level, key, h): every line of every message, once for equal rows; key and h, the
    line's hash and its part for sums, are null for blank lines."""
    split = F.split(F.coalesce("text", F.lit("")), "\n")
    rows = messages.select("conv_id", "turn", F.xxhash64("text").alias("row_key"), F.posexplode(split).alias("at", "line"))
    said = rows.select(*_MESSAGE, "at", _level(F.col("line")).alias("level"),
                       F.nullif(_said(F.col("line")), F.lit("")).alias("s"))
    key = F.when(F.col("s").isNotNull(), F.xxhash64("s"))
    return said.select(*_MESSAGE, "at", "level", key.alias("key"), key.bitwiseAND(F.lit(_HASH)).alias("h")).distinct()


def passages(lines: DataFrame) -> DataFrame:
    """(conv_id, turn, row_key, level, n, first, s0, s1): the passages with the number of their lines that say something,
    the key of the first, and their sums."""
    of_level = Window.partitionBy(*_MESSAGE, "level").orderBy("at")
    quoted = lines.where("level > 0").withColumn("passage", F.col("at") - F.row_number().over(of_level))
    inside = Window.partitionBy(*_MESSAGE, "level", "passage").orderBy("at")
    said = quoted.where("key is not null").withColumn("place", F.row_number().over(inside))
    return said.groupBy(*_MESSAGE, "level", "passage").agg(
        F.count("*").alias("n"), F.max(F.when(F.col("place") == 1, F.col("key"))).alias("first"),
        _exact(F.sum(_exact(F.col("h")))).alias("s0"),
        _exact(F.sum(_exact(F.col("h")) * F.col("place"))).alias("s1")).drop("passage")


def runs_said(lines: DataFrame, asked: DataFrame) -> DataFrame:
    """(conv_id, first, n, s0, s1, said_at): the runs of own lines that begin with the first line of a passage and are as
    long as it (``asked``: conv_id, first, n), with the first turn that says each."""
    order = Window.partitionBy(*_MESSAGE).orderBy("at")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = (lines.where("level = 0 and key is not null and conv_id is not null and turn is not null")
           .withColumn("place", F.row_number().over(order)))
    own = written(own.select(*_MESSAGE, "place", "key", "h", _exact(F.sum(_exact(F.col("h"))).over(so_far)).alias("c0"),
                             _exact(F.sum(_exact(F.col("h")) * F.col("place")).over(so_far)).alias("c1")), "own-lines")
    salted = (asked.where("conv_id is not null").withColumnsRenamed({"conv_id": "a_conv", "first": "a_first"})
              .withColumn("a_salt", F.explode(F.array(*[F.lit(i).cast("long") for i in range(SALTS)]))))
    start = own.withColumn("salt", F.pmod(F.xxhash64("turn", "row_key", "place"), F.lit(SALTS))).join(
        salted, (F.col("conv_id") == F.col("a_conv")) & (F.col("key") == F.col("a_first")) & (F.col("salt") == F.col("a_salt")))
    start = start.select(*_MESSAGE, F.col("key").alias("first"), "n", "place", (F.col("place") + F.col("n") - 1).alias("last"),
                         _exact(F.col("c0") - F.col("h")).alias("b0"),
                         _exact(F.col("c1") - _exact(F.col("h")) * F.col("place")).alias("b1"))
    ends = own.select(*[F.col(c).alias(f"e_{c}") for c in _MESSAGE], F.col("place").alias("e_place"), "c0", "c1")
    met = start.join(ends, (F.col("conv_id") == F.col("e_conv_id")) & (F.col("turn") == F.col("e_turn"))
                     & (F.col("row_key") == F.col("e_row_key")) & (F.col("last") == F.col("e_place")))
    s0 = _exact(F.col("c0") - F.col("b0"))
    sums = met.select("conv_id", "turn", "first", "n", "place", s0.alias("s0"), _exact(F.col("c1") - F.col("b1")).alias("t1"))
    sums = sums.withColumn("s1", _exact(F.col("t1") - F.col("s0") * (F.col("place") - 1)))
    return sums.groupBy("conv_id", "first", "n", "s0", "s1").agg(F.min("turn").alias("said_at"))


def originals(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, row_key, level, original): every passage with the turn it quotes, null if it is not linked."""
    lines = written(lines_of(messages), "message-lines")
    quoted = written(passages(lines), "passages")
    said = runs_said(lines, quoted.select("conv_id", "first", "n").distinct())
    said = said.withColumnsRenamed({c: f"r_{c}" for c in said.columns})
    same = F.col("turn") > F.col("r_said_at")
    for c in ("conv_id", "first", "n", "s0", "s1"):
        same &= F.col(c) == F.col(f"r_{c}")
    return quoted.join(said, same, "left").select(*_MESSAGE, "level", F.col("r_said_at").alias("original"))


def threads(replies: DataFrame) -> DataFrame:
    """(conv_id, turn, thread, depth) of every turn that replies to one: the turn its replies lead back to, and in how
    many steps. ``replies`` is (conv_id, turn, reply_to), each reply_to an earlier turn."""
    steps = (replies.where("reply_to is not null").groupBy("conv_id", "turn").agg(F.max("reply_to").alias("thread"))
             .withColumn("depth", F.lit(1).cast("long")))
    active, done = written(steps, "reply-steps"), None
    while True:  # rows whose thread replies to nothing are done; the others go on from where that turn has come to
        known = active if done is None else done.unionByName(active)
        up = known.select(F.col("conv_id").alias("u_conv"), F.col("turn").alias("u_turn"), F.col("thread").alias("u_thread"),
                          F.col("depth").alias("u_depth"))
        longer = active.join(up, (F.col("conv_id") == F.col("u_conv")) & (F.col("thread") == F.col("u_turn")), "left")
        after = written(longer.select("conv_id", "turn", F.coalesce("u_thread", "thread").alias("thread"),
                                      (F.col("depth") + F.coalesce("u_depth", F.lit(0))).alias("depth"),
                                      F.col("u_turn").isNotNull().alias("moved")), "reply-steps")
        ended, active = after.where("not moved").drop("moved"), after.where("moved").drop("moved")
        done = ended if done is None else done.unionByName(ended)
        if active.isEmpty():
            return done


def link(messages: DataFrame) -> DataFrame:
    """Per row of ``messages`` (conv_id, turn, role, text): conv_id, turn, role, body, max_level, n_passages, n_linked,
    reply_to, thread and depth."""
    found = originals(messages)
    each = written(found.groupBy(*_MESSAGE).agg(
        F.count("*").alias("n_passages"), F.count("original").alias("n_linked"),
        F.max(F.when(F.col("level") == 1, F.col("original"))).alias("reply_to")), "replies")
    chains = threads(each).withColumnsRenamed({"conv_id": "c_conv", "turn": "c_turn", "thread": "c_thread", "depth": "c_depth"})
    # a row's own reply, and from there on what the turn it answers replies to
    own = each.join(chains, (F.col("conv_id") == F.col("c_conv")) & (F.col("reply_to") == F.col("c_turn")), "left").select(
        *[F.col(c).alias(f"e_{c}") for c in _MESSAGE], "n_passages", "n_linked", "reply_to",
        F.coalesce("c_thread", "reply_to").alias("up"),
        F.when(F.col("reply_to").isNotNull(), 1 + F.coalesce("c_depth", F.lit(0))).alias("steps"))
    split = F.split(F.coalesce("text", F.lit("")), "\n")
    body = F.array_join(F.filter(split, lambda x: ~x.rlike(r"^[ \t]*>")), "\n")
    rows = messages.select("conv_id", "turn", "role", F.xxhash64("text").alias("row_key"),
                           F.trim(body, F.lit("\n")).alias("body"),
                           F.array_max(F.transform(split, _level)).alias("max_level"))
    same = F.lit(True)
    for c in _MESSAGE:
        same &= F.col(c).eqNullSafe(F.col(f"e_{c}"))
    return rows.join(own, same, "left").select(
        "conv_id", "turn", "role", "body", "max_level", F.coalesce("n_passages", F.lit(0)).alias("n_passages"),
        F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "reply_to", F.coalesce("up", "turn").alias("thread"),
        F.coalesce("steps", F.lit(0)).cast("long").alias("depth"))


def as_mail(conversations: DataFrame) -> DataFrame:
    """Turns written as replies by mail: each quotes the whole turn before, and above it, one level deeper, the whole
    turn before that."""
    before = (conversations.where("conv_id is not null and turn is not null and text is not null")
              .groupBy("conv_id", "turn").agg(F.min("text").alias("q")))

    def back(n: int) -> DataFrame:
        quoted = F.array_join(F.transform(F.split("q", "\n"), lambda x: F.concat(F.lit(">" * n + " "), x)), "\n")
        return before.select(F.col("conv_id").alias(f"c{n}"), (F.col("turn") + n).alias(f"t{n}"), quoted.alias(f"q{n}"))

    out = conversations
    for n in (1, 2):
        out = out.join(back(n), (F.col("conv_id") == F.col(f"c{n}")) & (F.col("turn") == F.col(f"t{n}")), "left")
    return out.select("conv_id", "turn", "role", F.concat_ws("\n", "q2", "q1", "text").alias("text"))
