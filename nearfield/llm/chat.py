r"""Chat formatting as a grammar round trip, in DataFrame functions only.

A conversation is a sequence of turns, each ``<s>[INST]role[/INST]text</s>``. Where a role or
text holds one of the four control strings, a backslash goes after its first character; one
that already has backslashes there gets one more, so taking one away restores any text.
The formatter renders each turn unescaped and reparses it strictly: control strings may stand
only where the frame has them, and what is recovered must be the source. A turn of which that
does not hold is rendered again with its role's and text's control strings escaped, whatever its neighbours
hold. Then the whole text is reparsed and compared; a difference that remains would stop the job.
So no control string is ever left raw in a role or text.

Turns are rendered in runs of ``RUN`` turn numbers, so that a conversation of any length is
spread over tasks, and only its runs' texts meet to be joined.

Defined cases: null text or role: empty; null turn numbers come first, equal ones are ordered
by role and text and each kept; a null conversation id is a conversation of its own; an
empty table gives an empty one; columns other than the four named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Turn numbers that are rendered together.
RUN = 64
OPEN, MIDDLE, CLOSE = "<s>[INST]", "[/INST]", "</s>"
#: Control strings of a turn's frame.
FRAME = 4
#: A control string's first character, the backslashes that it has, and its rest.
CONTROL = r"([<\[])(\\*)(?=(?:/?s>)|(?:/?INST\]))"
GUARDED = r"([<\[])\\(\\*)(?=(?:/?s>)|(?:/?INST\]))"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, GUARDED, "$1$2")


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(MIDDLE), text, F.lit(CLOSE))


def guarded(turn: Column, plain: Column) -> Column:
    """A turn's text: its plain rendering, escaped if a strict reader would not recover the turn from that."""
    recovered = F.get(parse(plain), F.lit(0))
    strict = (F.regexp_count(plain, F.lit(CONTROL)) == FRAME) & recovered.eqNullSafe(turn)
    return F.when(strict, plain).otherwise(render(escape(turn.role), escape(turn.text)))


def pieces(formatted: Column) -> Column:
    """Each turn's text as it stands between its opening and its closing string."""
    found = F.split(formatted, CLOSE)
    return F.transform(F.slice(found, F.lit(1), F.size(found) - 1), lambda p: F.substr(p, F.lit(len(OPEN) + 1)))


def parse(formatted: Column) -> Column:
    """The turns of a formatted text: an array of structs of role and text."""
    return F.transform(pieces(formatted), lambda p: F.struct(unescape(F.substring_index(p, MIDDLE, 1)).alias("role"), unescape(F.substr(p, F.instr(p, MIDDLE) + len(MIDDLE))).alias("text")))


def format_runs(turns: DataFrame) -> DataFrame:
    """A row for each conversation and run of turns: the text, its parsed turns and loss spans."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    runs = rows.groupBy("conv_id", F.floor(F.col("turn") / RUN).alias("run")).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    runs = runs.withColumn("turns", F.transform("turns", lambda t: F.struct(t.role.alias("role"), t.text.alias("text"))))
    runs = runs.withColumn("plain", F.transform("turns", lambda t: render(t.role, t.text)))
    runs = runs.withColumn("formatted", F.array_join(F.zip_with("turns", "plain", guarded), ""))
    runs = runs.withColumn("parsed", parse(F.col("formatted")))
    runs = runs.withColumn("parsed", F.when(F.col("parsed") == F.col("turns"), F.col("parsed")).otherwise(F.raise_error(F.lit("a formatted conversation does not parse to its turns"))))
    sizes = F.transform(pieces(F.col("formatted")), lambda p: F.struct(F.length(p).alias("whole"), F.length(F.substring_index(p, MIDDLE, 1)).alias("role")))
    frame = len(OPEN) + len(CLOSE)
    spans = F.transform(
        "sizes",
        lambda s, i: F.struct(
            (F.aggregate(F.slice("sizes", F.lit(1), i), F.lit(0), lambda n, x: n + x.whole + frame) + len(OPEN) + s.role + len(MIDDLE)).cast("long").alias("start"),
            (s.whole - s.role - len(MIDDLE)).cast("long").alias("length"),
            F.get(F.col("parsed"), i).role.alias("role"),
        ),
    )
    runs = runs.withColumn("sizes", sizes).withColumn("spans", F.filter(spans, lambda s: s.role == "assistant"))
    return runs.select("conv_id", "run", "formatted", "parsed", F.transform("spans", lambda s: F.struct(s.start.alias("start"), s.length.alias("length"))).alias("loss_spans"))


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation: its text, what parsing recovers, and what the loss covers.

    ``formatted``; ``n_turns``; ``turns_text`` (role, newline, text, newline of each recovered
    turn); ``loss_text`` (read from the text at the loss spans, unescaped); ``loss_spans`` (start
    and length in characters of ``formatted``).
    """
    runs = format_runs(turns)
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s.start + 1).cast("int"), s.length.cast("int")))), "")
    told = F.array_join(F.transform("parsed", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    runs = runs.select("conv_id", F.struct("run", "formatted", F.size("parsed").cast("long").alias("n"), told.alias("told"), loss.alias("loss"), "loss_spans").alias("r"))
    whole = runs.groupBy("conv_id").agg(F.sort_array(F.collect_list("r")).alias("runs"))
    joined = lambda field: F.array_join(F.transform("runs", lambda r: r[field]), "")
    moved = F.aggregate(
        "runs",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda acc, r: F.struct((acc.at + F.length(r.formatted)).cast("long").alias("at"), F.concat(acc.spans, F.transform(r.loss_spans, lambda s: F.struct((s.start + acc.at).alias("start"), s.length.alias("length")))).alias("spans")),
        lambda acc: acc.spans,
    )
    return whole.select("conv_id", joined("formatted").alias("formatted"), F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r.n).alias("n_turns"), joined("told").alias("turns_text"), joined("loss").alias("loss_text"), moved.alias("loss_spans"))
