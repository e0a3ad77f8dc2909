"""Chat formatting by quotation linking, in DataFrame operations only.

Quote levels are parsed line by line. The sentences and lines of what is quoted at the
shallowest level are normalised and hashed, and joined within the conversation to the
latest earlier message that says them itself; so are, for sentences that were cut, all
runs of PART words and the sentences and lines that are shorter. The message with the
most weight is the one replied to. A message that answers another than the one before it
opens a branch. Conversations are put in the order of their reply trees, depth first, so
that every reply stands below its original, without the quotes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import RowFilter, Scratch

#: Turns in a stretch of a conversation; windows run within stretches and over them, so a
#: conversation of any length is dealt over many tasks.
STRETCH = 1024

#: Words of a run that is looked for within sentences.
PART = 5

_WROTE = "(?i)^(on|am|le|el)\\\\b.*\\\\b(wrote|schrieb|écrit|escribió)\\\\s*:$|^.{1,80}\\\\b(wrote|schrieb)\\\\s*:$"


def _plain(text: str) -> str:
    return f"trim(regexp_replace(lower({text}), '[^\\\\p{{L}}\\\\p{{N}}]+', ' '))"


def _sentences(text: str) -> str:
    return f"transform(split({text}, '(?<=[.!?…])\\\\s+|(?<=[。！？｡])\\\\s*'), s -> {_plain('s')})"


def _words(text: str) -> str:
    """Some scripts don't part words: each of their letters counts as one."""
    letters = "".join(f"\\\\p{{Is{x}}}" for x in ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar"))
    return f"filter(split(regexp_replace({_plain(text)}, '([{letters}])', ' $1 '), ' '), w -> w <> '')"


def _runs(words: str, n: int) -> str:
    """Hashes of all runs of ``n`` of the words."""
    return f"CASE WHEN size({words}) >= {n} THEN transform(sequence(1, size({words}) - {n - 1}), i -> xxhash64('part', array_join(slice({words}, i, {n}), ' '))) ELSE array() END"


def parse_quotes(messages: DataFrame) -> DataFrame:
    """``messages`` with own (text without quotes and their attribution lines), own_hashes, quoted_hashes, quoted_parts, levels."""
    lines = messages.withColumn("l", F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\\r?\\n"))
    lines = lines.withColumn("l", F.expr("transform(l, x -> named_struct('mark', regexp_extract(x, '^(?:[ \\\\t]*>)*', 0), 'x', x))"))
    lines = lines.withColumn("l", F.expr("transform(l, x -> named_struct('level', length(x.mark) - length(replace(x.mark, '>', '')), 'x', trim(substring(x.x, length(x.mark) + 1, length(x.x))), 'raw', x.x))"))
    lines = lines.withColumn("l", F.expr(f"transform(l, (x, i) -> named_struct('level', x.level, 'x', x.x, 'raw', x.raw, 'wrote', coalesce(get(l, i + 1).level, 0) > x.level AND x.x rlike '{_WROTE}'))"))
    lines = lines.withColumn("own_lines", F.expr("filter(l, x -> x.level = 0 AND NOT x.wrote)"))
    lines = lines.withColumn("quoted_lines", F.expr("filter(l, x -> x.level > 0 AND x.x <> '' AND NOT x.wrote)"))
    lines = lines.withColumn("quoted_lines", F.expr("filter(quoted_lines, x -> x.level = array_min(transform(quoted_lines, y -> y.level)))"))
    joined = lambda c: f"array_join(transform({c}, x -> x.x), ' ')"
    pieces = lambda c: F.expr(f"filter(array_distinct(concat({_sentences(joined(c))}, transform({c}, x -> {_plain('x.x')}))), s -> s <> '')")
    hashed = lambda p, c: f"array_append(transform({p}, s -> xxhash64(s)), xxhash64('whole', {_plain(joined(c))}))"
    lines = lines.withColumns({"own_pieces": pieces("own_lines"), "quoted_pieces": pieces("quoted_lines"), "quoted_words": F.expr(_words(joined("quoted_lines")))})
    # Short pieces, and all that is quoted if that is short, are looked for whole.
    short = f"transform(filter(transform(array_append(quoted_pieces, array_join(quoted_words, ' ')), s -> {_words('s')}), w -> size(w) BETWEEN 1 AND {PART - 1}), w -> xxhash64('part', array_join(w, ' ')))"
    return lines.select(
        *messages.columns,
        F.expr("trim(BOTH '\\n' FROM array_join(transform(own_lines, x -> x.raw), '\\n'))").alias("own"),
        F.expr(hashed("own_pieces", "own_lines")).alias("own_hashes"),
        F.expr(f"CASE WHEN size(quoted_lines) > 0 THEN {hashed('quoted_pieces', 'quoted_lines')} ELSE array() END").alias("quoted_hashes"),
        F.expr(f"array_distinct(concat({_runs('quoted_words', PART)}, {short}))").alias("quoted_parts"),
        F.expr("array_max(transform(l, x -> x.level))").alias("levels"),
    )


def _before(rows: DataFrame, keys: list[str], order: list, values: dict[str, str]) -> DataFrame:
    """``rows`` with, for each of ``values`` (name: aggregate of a column), its value over all rows up to this one.

    Runs over each (keys, stretch) and then over the stretches' own totals.
    """
    inner = Window.partitionBy(*keys, "stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    outer = Window.partitionBy(*keys).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "stretch").agg(*(F.expr(a).alias(f"{n}_total") for n, a in values.items()))
    carried = totals.select(*keys, "stretch", *(F.expr(f"{a.split('(')[0].replace('count', 'sum')}({n}_total)").over(outer).alias(f"{n}_before") for n, a in values.items()))
    near = rows.withColumns({f"{n}_near": F.expr(a).over(inner) for n, a in values.items()})
    carried = carried.withColumnsRenamed({k: f"k_{k}" for k in [*keys, "stretch"]})
    joined = near.join(carried, [near[k].eqNullSafe(carried[f"k_{k}"]) for k in [*keys, "stretch"]], "left")
    both = {n: F.coalesce(F.col(f"{n}_before"), F.lit(0)) + F.col(f"{n}_near") if a.startswith(("count", "sum")) else F.greatest(f"{n}_before", f"{n}_near") for n, a in values.items()}
    return joined.withColumns(both).drop(*(f"{n}_{x}" for n in values for x in ("before", "near")), *(f"k_{k}" for k in [*keys, "stretch"]))


def _following(rows: DataFrame, keys: list[str], order: list[str], chunks: list[list[str]]) -> DataFrame:
    """``rows`` with ``next``, the branch of the next row by ``order`` among those of equal ``keys``.

    Runs within chunks (columns that agree with the order) and then over the chunks' first rows.
    """
    if not chunks:
        return rows.withColumn("next", F.lead("branch").over(Window.partitionBy(*keys).orderBy(*order)))
    inner = [*keys, *chunks[0]]
    near = rows.withColumn("near", F.lead("branch").over(Window.partitionBy(*inner).orderBy(*order)))
    firsts = rows.groupBy(*inner).agg(F.min_by("branch", F.struct(*order)).alias("branch"))
    firsts = _following(firsts, keys, chunks[0], chunks[1:]).select(*inner, F.col("next").alias("far"))
    return near.join(firsts, inner).withColumn("next", F.coalesce("near", "far")).drop("near", "far")


def _ahead(placed: DataFrame, scratch: Scratch) -> DataFrame | None:
    """For each branch (cid, branch) of conversations with several, how many messages come before it depth first.

    A branch is a run of messages that each answer the one before; it hangs on the message
    that its first one quotes. Depth first, a branch's messages come one after another and
    then the branches that hang on them, those on its last messages first. Entering and
    leaving each branch are the steps of one walk; each step learns what the walk still
    counts from there by doubling how far it points, in as many rounds as the number of
    steps has binary digits.
    """
    branches = placed.groupBy("cid", "branch").agg(F.count("*").alias("n"), F.max(F.when(F.col("key") == F.col("branch"), F.col("quoted"))).alias("at"))
    counted = branches.groupBy("cid").agg(F.count("*").alias("branches"), F.sum("n").alias("total")).where("branches > 1")
    most = counted.agg(F.max("branches")).first()[0]
    if most is None:
        return None
    branches = scratch.keep(branches.join(counted.select("cid", "total"), "cid"))
    turns = placed.select("cid", F.col("key").alias("at"), F.col("branch").alias("up")).distinct()
    hung = branches.where("at is not null").join(turns, ["cid", "at"]).select("cid", "up", "branch", (-F.col("at")).alias("late"))
    hung = hung.withColumns({"lates": F.floor(F.col("late") / STRETCH), "opened": F.floor(F.col("branch") / STRETCH)})
    hung = scratch.keep(_following(hung, ["cid", "up"], ["late", "branch"], [["lates", "late", "opened"], ["lates"]]))
    firsts = hung.groupBy("cid", "up").agg(F.min_by("branch", F.struct("late", "branch")).alias("down")).withColumnRenamed("up", "branch")
    steps = branches.join(firsts, ["cid", "branch"], "left").join(hung.select("cid", "branch", "up", "next"), ["cid", "branch"], "left")
    enter = F.struct(F.lit(False).alias("leave"), F.col("branch").alias("of"), F.coalesce("down", "branch").alias("to"), F.col("down").isNull().alias("to_leave"), F.col("n").alias("rest"))
    leave = F.struct(F.lit(True).alias("leave"), F.col("branch").alias("of"), F.coalesce("next", "up").alias("to"), F.col("next").isNull().alias("to_leave"), F.lit(0).cast("long").alias("rest"))
    steps = scratch.keep(steps.select("cid", F.inline(F.array(enter, leave))))
    for _ in range((2 * most).bit_length()):
        then = steps.select("cid", F.col("of").alias("to"), F.col("leave").alias("to_leave"), F.col("to").alias("then"), F.col("to_leave").alias("then_leave"), F.col("rest").alias("more"))
        further = steps.join(then, ["cid", "to", "to_leave"], "left")
        further = scratch.keep(further.select("cid", "leave", "of", F.col("then").alias("to"), F.col("then_leave").alias("to_leave"), (F.col("rest") + F.coalesce("more", F.lit(0))).alias("rest")))
        scratch.drop(steps)
        steps = further
    return steps.where("not leave").join(branches.select("cid", F.col("branch").alias("of"), "total"), ["cid", "of"]).select("cid", F.col("of").alias("branch"), (F.col("total") - F.col("rest")).alias("ahead"))


def chat_format(messages: DataFrame) -> DataFrame:
    """One row per row of ``messages`` (conv_id, turn, role, text): conv_id, turn, role, reply_to, linked, quote_levels, branch, position, text, chat.

    reply_to is the turn of the message quoted (linked = true) or else of the one before;
    a quote is linked by any whole sentence or line, any PART words in a row, or all of a shorter passage;
    null for a conversation's first. ``branch`` is the turn that opened the message's
    branch, ``position`` its place from 0 in the reply tree depth first (replies to one message
    by turn), ``text`` what
    it says itself, and ``chat`` that with its role marked. Null text counts as empty; a
    null conv_id is a conversation of its own, null turns come first; a null role is
    written as user. Rows repeated with one turn stand together. Other columns are ignored.
    """
    scratch = Scratch(messages.sparkSession)
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    parsed = scratch.keep(parse_quotes(rows).drop("text").withColumn("uid", F.monotonically_increasing_id()).withColumn("stretch", F.floor(F.coalesce("turn", F.lit(-1)) / STRETCH)))
    # A quote's parts together weigh as much as one sentence, so that whole sentences decide.
    weighed = F.expr("concat(transform(quoted_hashes, h -> named_struct('h', h, 'w', 1D)), transform(quoted_parts, h -> named_struct('h', h, 'w', 1D / size(quoted_parts))))")
    quotes = parsed.where(F.size("quoted_hashes") > 0).select("uid", "conv_id", "turn", "stretch", F.inline(weighed))
    own = RowFilter(quotes, "conv_id").some(parsed, "conv_id").where("turn is not null").withColumn("words", F.expr(_words("own")))
    parts = F.expr(f"array_distinct(concat({', '.join(_runs('words', n) for n in range(1, PART + 1))}))")
    said = own.select("conv_id", "turn", "stretch", F.explode(F.concat("own_hashes", parts)).alias("h"))
    said = RowFilter(quotes, "conv_id", "h").some(said, "conv_id", "h").distinct()  # most sentences are quoted by nobody
    events = quotes.select("uid", "conv_id", "h", "w", "stretch", "turn", F.lit(None).cast("long").alias("original"))
    events = events.unionByName(said.select(F.lit(None).cast("long").alias("uid"), "conv_id", "h", F.lit(None).cast("double").alias("w"), "stretch", "turn", F.col("turn").alias("original")))
    linked = _before(events, ["conv_id", "h"], [F.col("turn"), F.col("original").isNotNull()], {"source": "max(original)", "sources": "count(original)"})
    # A sentence that several earlier messages say counts less; ties go to the later message.
    votes = linked.where("uid is not null and source is not null and source < turn").groupBy("uid", "source").agg(F.sum(F.col("w") / F.col("sources")).alias("weight"))
    links = votes.groupBy("uid").agg(F.max_by("source", F.struct(F.round("weight", 6), "source")).alias("quoted"))

    placed = parsed.select("uid", "conv_id", "turn", "stretch").join(links, "uid", "left")
    placed = placed.withColumn("key", F.coalesce("turn", F.lit(-(1 << 62))))
    turns = placed.select("conv_id", "stretch", "key").distinct()
    step = Window.partitionBy("conv_id", "stretch").orderBy("key")
    last = turns.groupBy("conv_id", "stretch").agg(F.max("key").alias("last"))
    last = last.select("conv_id", "stretch", F.lag("last").over(Window.partitionBy("conv_id").orderBy("stretch")).alias("carried"))
    turns = turns.withColumn("lag", F.lag("key").over(step))
    turns = turns.join(last.withColumnsRenamed({"conv_id": "c", "stretch": "s"}), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("stretch") == F.col("s")))
    turns = turns.select(F.col("conv_id").alias("c"), F.col("key").alias("k"), F.coalesce("lag", "carried").alias("previous"))
    placed = placed.join(turns, placed["conv_id"].eqNullSafe(turns["c"]) & (placed["key"] == turns["k"])).drop("c", "k")
    opens = F.col("previous").isNull() | (F.col("quoted").isNotNull() & (F.col("quoted") != F.col("previous")))
    placed = _before(placed.withColumn("opened", F.when(opens, F.col("key"))), ["conv_id"], [F.col("key"), F.col("uid")], {"branch": "max(opened)"})
    # Rows of one turn share the branch that any of them opens.
    placed = placed.withColumn("branch", F.max("branch").over(Window.partitionBy("conv_id", "key")))

    placed = scratch.keep(placed.withColumn("cid", F.coalesce(F.col("conv_id").cast("string"), F.lit(""))))
    ahead = _ahead(placed, scratch)
    runs = placed.groupBy("cid", "branch", "stretch").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("cid", "branch").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("cid", "branch", "stretch", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    placed = placed.withColumn("within", F.row_number().over(Window.partitionBy("cid", "branch", "stretch").orderBy("key", "uid")) - 1)
    placed = placed.join(runs, ["cid", "branch", "stretch"])
    if ahead is not None:
        placed = placed.join(ahead, ["cid", "branch"], "left")
    position = F.col("before") + F.col("within") + (F.lit(0) if ahead is None else F.coalesce("ahead", F.lit(0)))
    known = lambda c: F.when(F.col(c) > -(1 << 62), F.col(c))
    placed = placed.select("uid", F.coalesce("quoted", known("previous")).alias("reply_to"), F.col("quoted").isNotNull().alias("linked"), known("branch").alias("branch"), position.alias("position"))
    out = parsed.join(placed, "uid")
    chat = F.concat(F.lit("<|"), F.coalesce("role", F.lit("user")), F.lit("|>\n"), F.col("own"), F.lit("\n"))
    return out.select("conv_id", "turn", "role", "reply_to", "linked", F.col("levels").cast("long").alias("quote_levels"), "branch", "position", F.col("own").alias("text"), chat.alias("chat"))
