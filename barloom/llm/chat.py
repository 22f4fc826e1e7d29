"""Conversations from messages that quote each other.  Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.quality_rules import let
from barloom.sources.readers import materialize

MARKS = r"^((?:> ?)*)"
ATTRIBUTION = r"^On\b.*\bwrote:\s*$"


def parse(messages: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``own``, the text without quotes and the lines that announce them, and ``quotes``, (level, line) of the quoted ones.

    A line's level is the number of ``>`` at its start, with or without single spaces between them.  Blank lines at the
    ends of ``own`` are cut off.  A null text has a null ``own`` and no quotes.
    """
    lines = F.transform(F.split(F.col(text), "\r?\n"), lambda x: F.struct(
        F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 1), "[^>]", "")).alias("level"), F.regexp_replace(x, MARKS, "").alias("line")))
    own = F.filter(lines, lambda x: (x["level"] == 0) & ~F.regexp_like(x["line"], F.lit(ATTRIBUTION)))
    return messages.withColumns({
        "own": F.regexp_replace(F.array_join(F.transform(own, lambda x: x["line"]), "\n"), r"^(?:[ \t]*\n)+|\s+$", ""),
        "quotes": F.coalesce(F.filter(lines, lambda x: x["level"] > 0), F.array().cast("array<struct<level:int,line:string>>"))})


def passages(text: Column) -> Column:
    """Hashes of the distinct sentences of a text, without case and line breaks; rewrapped quotes keep theirs."""
    plain = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    return F.array_distinct(F.transform(F.filter(F.split(plain, r"(?<=[.!?]) "), lambda x: x != ""), lambda x: F.xxhash64(x)))


def links(messages: DataFrame) -> DataFrame:
    """(id, level, quoted_id, n_passages, of_thread): the message that each quote level of a message comes from.

    ``messages``: id, thread, rank, own, quotes.  A quoted passage stands for the first message (least rank, then least
    id) of the same thread that holds it as its own text, or else for the first one of all; it must be of lower rank.
    The message that most passages of a level stand for is the quoted one, one of the same thread before others, then
    the first.  Passages are reduced to their first holder before the join, so a sentence that every message holds makes one
    row per passage and no pairs.
    """
    held = messages.where("own is not null").select("id", "thread", "rank", F.explode(passages(F.col("own"))).alias("h"))
    first = F.min(F.struct("rank", "id")).alias("first")
    in_thread = held.groupBy("thread", "h").agg(first)
    anywhere = in_thread.groupBy("h").agg(F.min("first").alias("any"))
    levels = F.transform(F.array_distinct(F.transform("quotes", lambda q: q["level"])), lambda n: F.struct(
        n.alias("level"), passages(F.array_join(F.transform(F.filter("quotes", lambda q: q["level"] == n), lambda q: q["line"]), " ")).alias("hs")))
    quoted = messages.where(F.size("quotes") > 0).select("id", "thread", "rank", F.explode(levels).alias("q"))
    quoted = quoted.select("id", "thread", "rank", F.col("q.level").alias("level"), F.explode("q.hs").alias("h"))
    both = quoted.join(in_thread, ["thread", "h"], "left").join(anywhere, "h", "left")
    near = F.col("first.rank") < F.col("rank")
    far = F.col("any.rank") < F.col("rank")
    best = F.when(near, F.struct(F.lit(True).alias("of_thread"), F.col("first.rank").alias("r"), F.col("first.id").alias("i"))).when(
        far, F.struct(F.lit(False).alias("of_thread"), F.col("any.rank").alias("r"), F.col("any.id").alias("i")))
    counted = both.withColumn("b", best).where("b is not null").groupBy("id", "level", "b").agg(F.count("*").alias("n"))
    order = F.struct((~F.col("b.of_thread")).alias("other"), (-F.col("n")).alias("n"), F.col("b.r").alias("r"), F.col("b.i").alias("i"))
    chosen = counted.groupBy("id", "level").agg(F.min(order).alias("b"))
    return chosen.select("id", "level", F.col("b.i").alias("quoted_id"), (-F.col("b.n")).alias("n_passages"), (~F.col("b.other")).alias("of_thread"))


def climb(parents: DataFrame) -> DataFrame:
    """(id, root_id, depth) from (id, parent_id) without cycles, every parent being an id.

    Each message looks up where the one it points to points, which doubles the steps of a round; those that point to a
    root are done and leave the rounds, so long threads alone take part in the later ones.
    """
    done = [parents.where("parent_id is null").select("id", F.col("id").alias("up"), F.lit(0).alias("depth"))]
    todo = parents.where("parent_id is not null").select("id", F.col("parent_id").alias("up"), F.lit(1).alias("depth"))
    while todo.limit(1).count():
        above = todo
        for part in done:
            above = above.unionByName(part)
        above = above.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        moved = materialize(todo.join(above, "up").select(
            "id", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("more") == 0).alias("final")), "climb")
        done.append(moved.where("final").drop("final"))
        todo = moved.where("not final").drop("final")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select("id", F.col("up").alias("root_id"), "depth")


def conversations(messages: DataFrame, text: str = "text") -> DataFrame:
    """One row per message in reply order (root_id, depth, rank, id): its columns, and own (the text without quotes),
    n_quoted (quoted lines), parent_id, root_id and depth; existing columns of these names are replaced.

    ``messages``: id (integer), thread (a hint such as a list or a subject; may be null), rank (their order in time) and
    the text.  The parent is the source of the least quote level that has one, so a reply to a lost message hangs below
    what that message had quoted.  A message that quotes nothing known starts a conversation.  Repeated rows of one id are
    one message for the links and stay as rows; a message with a null id or rank stands alone, with its id as root.
    """
    parsed = parse(messages.withColumn("thread", F.col("thread").cast("string")), text)
    slim = parsed.where("id is not null and rank is not null").select("id", F.coalesce("thread", F.concat(F.lit("\u0000"), F.col("id").cast("string"))).alias("thread"), "rank", "own", "quotes")
    slim = slim.groupBy("id").agg(F.min(F.struct("rank", "thread", "own", "quotes")).alias("m")).select("id", "m.*")
    slim = materialize(slim, "messages")
    up = links(slim).groupBy("id").agg(F.min(F.struct("level", "quoted_id")).alias("l")).select("id", F.col("l.quoted_id").alias("parent_id"))
    parents = materialize(slim.select("id").join(up, "id", "left"), "parents")
    placed = climb(parents).join(parents, "id")
    keep = [c for c in messages.columns if c not in ("own", "quotes", "n_quoted", "parent_id", "root_id", "depth")]
    out = parsed.withColumn("n_quoted", F.size("quotes").cast("long")).select(*keep, "own", "n_quoted").join(placed, "id", "left")
    return out.withColumn("root_id", F.coalesce("root_id", "id")).withColumn("depth", F.coalesce("depth", F.lit(0)))


def template(role: Column, own: Column) -> Column:
    """A turn in chat markup."""
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("user")), F.lit("|>\n"), F.coalesce(own, F.lit("")), F.lit("\n<|end|>\n"))


def quoting(turns: DataFrame, depth: int = 3) -> DataFrame:
    """Mails out of (conv_id, turn, role, text): every turn quotes the one before it, with what that quotes, ``depth`` deep.

    id is conv_id * 2^20 + turn, thread the conversation and rank the turn.  Ids are null, so that such mails stand alone,
    where conv_id or turn is null, the turn is not in 0 to 2^20 - 1 or conv_id leaves 43 bits.  Of repeated turns the least
    text is quoted, and each stays a mail of the same id.  A turn whose predecessor is missing or null quotes nothing, and
    quotes end before the first such gap.  A null text stays null.
    """
    earlier = turns.where("text is not null").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))

    def quote(t: Column) -> Column:
        return F.concat(F.lit("> "), F.regexp_replace(t, "\n", "\n> "))

    body = turns
    for k in range(1, depth + 1):
        body = body.join(earlier.select("conv_id", (F.col("turn") + k).alias("turn"), F.col("text").alias(f"_{k}")), ["conv_id", "turn"], "left")
    block = F.lit("")
    for k in range(depth, 0, -1):
        inner = let(block, lambda b: F.when(b == "", F.lit("")).otherwise(F.concat(F.lit("\n"), quote(b))))
        block = F.when(F.col(f"_{k}").isNull(), F.lit("")).otherwise(F.concat(quote(F.col(f"_{k}")), inner))
    mail = let(block, lambda b: F.when(b == "", F.col("text")).otherwise(F.concat(F.col("text"), F.lit("\n\nOn the day before they wrote:\n"), b)))
    fits = F.col("turn").between(0, (1 << 20) - 1) & F.col("conv_id").between(-(1 << 43), (1 << 43) - 1)
    return body.select("conv_id", "turn", "role", F.when(fits, F.col("conv_id") * (1 << 20) + F.col("turn")).alias("id"), F.col("conv_id").cast("string").alias("thread"),
                       F.col("turn").alias("rank"), mail.alias("text"))
