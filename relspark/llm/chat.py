"""Chat formatting in budgeted windows, with DataFrame functions only (operator 10).

Turns of a conversation are dealt to windows by prefix sums of their token counts.  Every window opens with the
conversation's system turn, goes on with the last turns before it (repeated, without loss) and then holds its own
turns whole.  The loss mask covers the assistant texts among a window's own turns, so each is a target once.

Template: `<|im_start|>role\\ntext<|im_end|>\\n`.  In texts, `<|` would open a control string, so `<`, any number of
backslashes and `|` get one backslash more; roles write `%`, newline and the bar of `<|` as %25, %0A and %7C.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import keep

#: Conversations of more turns are numbered by several tasks.
LONG = 100_000
#: The ids of so many long conversations are broadcast, at eight bytes each; if there are more, all turns are dealt.
MOST = 1_000_000
START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    for a, b in (("%", "%25"), ("\n", "%0A"), ("<|", "<%7C")):
        role = F.replace(role, F.lit(a), F.lit(b))
    return role


def unescape_role(role: Column) -> Column:
    for a, b in (("<%7C", "<|"), ("%0A", "\n"), ("%25", "%")):
        role = F.replace(role, F.lit(a), F.lit(b))
    return role


def word_tokens(text: Column) -> Column:
    """A cheap stand-in for a tokenizer: one token for about four characters, and one for each turn."""
    return F.floor(F.length(text) / 4) + 1


def _dealt(t: DataFrame) -> DataFrame:
    """Turns with pos, which ascends with conv_id, turn, role and text, and part: a conversation of many turns is in
    several parts, each with a range of them."""
    order = ["conv_id", "turn", "role"]  # turns that agree in these go together; texts would be sampled whole
    return keep(t.repartitionByRange(*order).sortWithinPartitions(*order, "text").withColumn("pos", F.monotonically_increasing_id()), "turns").withColumn("part", F.shiftright("pos", 33))


def _with_carry(t: DataFrame, carry: DataFrame) -> DataFrame:
    """carry: (c_id, c_part, ...), of conversations in several parts only.  A part shares at most two conversations with
    others, so that is two rows for each part at most, whatever the number of turns."""
    return t.join(F.broadcast(carry), t["conv_id"].eqNullSafe(carry["c_id"]) & (t["part"] == carry["c_part"]), "left").drop("c_id", "c_part")


def _first_carry(t: DataFrame, before, parts) -> DataFrame:
    """What the parts before bring to the prefix sums, and the last turn of the part before."""
    zero = F.lit(0).cast("long")
    ends = t.groupBy("conv_id", "part").agg(F.count("*").alias("rows"), F.max("sum").alias("sums"), F.max("longs").alias("long_rows"), F.max("edge").alias("edges"), F.max_by("n", "pos").alias("last_n"), F.max_by("long", "pos").alias("last_long"))
    ends = ends.withColumn("parts", F.count("*").over(Window.partitionBy("conv_id"))).filter("parts > 1")
    ends = ends.withColumn("c_sum", F.coalesce(F.sum("sums").over(before), zero))
    ends = ends.select(
        F.col("conv_id").alias("c_id"), F.col("part").alias("c_part"), "c_sum", F.coalesce(F.sum("rows").over(before), zero).alias("c_rows"), F.coalesce(F.sum("long_rows").over(before), zero).alias("c_longs"),
        F.max(F.col("edges") + F.col("c_sum")).over(before).alias("c_edge"), F.lag("last_n").over(parts).alias("p_n"), F.lag("last_long").over(parts).alias("p_long"),
    )
    return _with_carry(t, ends)


def _second_carry(t: DataFrame, before, after, history: int) -> DataFrame:
    """How many windows the parts before open, how many there are, and the first turns of the parts after."""
    zero = F.lit(0).cast("long")
    spread = t.filter("c_rows is not null")
    carry = spread.groupBy("conv_id", "part").agg(F.sum(F.col("begins").cast("long")).alias("opened"), F.sort_array(F.collect_list(F.when(F.col("place") <= history, F.struct("place", "begins", "sum", "n", F.col("opened").alias("window"))))).alias("head"))
    carry = carry.withColumn("w_before", F.coalesce(F.sum("opened").over(before), zero)).withColumn("w_all", F.sum("opened").over(Window.partitionBy("conv_id")))
    carry = carry.withColumn("head", F.transform("head", lambda x: F.struct(x["begins"].alias("begins"), x["sum"].alias("sum"), x["n"].alias("n"), (x["window"] + F.col("w_before") - 1).alias("window"))))
    following = F.slice(F.flatten(F.collect_list("head").over(after)), 1, max(history, 1))
    carry = carry.select(F.col("conv_id").alias("c_id"), F.col("part").alias("c_part"), "w_before", "w_all", following.alias("following"))
    return _with_carry(t.drop("c_rows", "c_sum", "c_longs", "c_edge", "p_n", "p_long"), carry)


def windows(conversations: DataFrame, budget: int = 1024, history: int = 2, tokens: Callable[[Column], Column] = word_tokens, target: str = "assistant") -> DataFrame:
    """One row per window: conv_id, window (from 0), n_repeated (leading turns that are repeats), n_turns (own ones),
    formatted, loss (array of start, length: code points of formatted under the mask), n_tokens, over (beyond budget).

    Turns of a conversation are numbered by one task, unless there are more than LONG of them: those are dealt by ranges
    and numbered by several tasks (but turns of the same number and role by one).  Windows are made each by itself.

    Turns go by turn, then role and text; null turns first, null roles and texts as empty ones.  Repeated rows are
    turns of their own.  A null conv_id is a conversation.  Other columns are ignored.

    A share of half the budget is kept for the system turn and history; repeats that do not fit their share are left
    out, the system turn never.  A turn of over a quarter of the budget is a window of its own and never cut, so only
    such a window, or one under a long system turn, can be over.
    """
    t = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("n", tokens(F.col("text")).cast("long"))
    long = keep(t.groupBy("conv_id").agg(F.count("*").alias("turns")).filter(F.col("turns") > LONG).select(F.col("conv_id").alias("long_id")), "long")
    how_many = long.count()
    if not how_many:
        return _formatted(_numbered(t, budget, history, False), budget, target)
    if how_many > MOST:
        return _formatted(_numbered(t, budget, history, True), budget, target)
    one, several = (t.join(F.broadcast(long), F.col("conv_id").eqNullSafe(F.col("long_id")), kind) for kind in ("left_anti", "left_semi"))
    return _formatted(_numbered(one, budget, history, False), budget, target).unionByName(_formatted(_numbered(several, budget, history, True), budget, target))


def _numbered(t: DataFrame, budget: int, history: int, dealt: bool) -> DataFrame:
    """Turns with their window, place in the conversation and the windows that repeat them.  dealt: by ranges."""
    share = budget // 4
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    if dealt:
        t = _dealt(t)
        here = Window.partitionBy("part", "conv_id")
        one = here.orderBy("pos")
    else:
        here = Window.partitionBy("conv_id")
        one = here.orderBy("turn", "role", "text")
    t = t.withColumn("long", F.col("n") > share)
    upto = one.rowsBetween(Window.unboundedPreceding, 0)
    parts = Window.partitionBy("conv_id").orderBy("part")
    before, after = parts.rowsBetween(Window.unboundedPreceding, -1), parts.rowsBetween(1, Window.unboundedFollowing)
    # prefix sums inside a part, and for conversations of several parts what the parts before bring
    t = t.withColumns({"place": F.row_number().over(one).cast("long"), "sum": F.sum("n").over(upto), "longs": F.sum(F.col("long").cast("long")).over(upto)})
    t = t.withColumn("edge", F.max(F.when(F.col("long"), F.col("sum"))).over(upto))
    t = _first_carry(t, before, parts) if dealt else t.withColumns({c: none for c in ("c_sum", "c_rows", "c_longs", "c_edge", "p_n")} | {"p_long": F.lit(None).cast("boolean")})
    t = t.withColumn("at", F.col("place") + F.coalesce("c_rows", zero)).withColumn("sum", F.col("sum") + F.coalesce("c_sum", zero)).withColumn("longs", F.col("longs") + F.coalesce("c_longs", zero))
    t = t.withColumn("edge", F.coalesce(F.greatest(F.col("edge") + F.coalesce("c_sum", zero), "c_edge"), zero))

    # runs of ordinary turns between long ones; in a run, a new window begins where the prefix sum enters a new share
    def run_and_cell(long: Column, longs: Column, total: Column, n: Column, edge: Column) -> Column:
        return F.struct((longs * 2 + F.when(long, 1).otherwise(2)).alias("run"), F.when(long, zero).otherwise(F.floor((total - n - edge) / share)).alias("cell"))

    t = t.withColumn("own", run_and_cell(F.col("long"), F.col("longs"), F.col("sum"), F.col("n"), F.col("edge")))
    previous = F.when(F.col("p_n").isNotNull(), run_and_cell(F.col("p_long"), F.col("c_longs"), F.col("c_sum"), F.col("p_n"), F.coalesce("c_edge", zero)))
    previous = F.when(F.col("place") > 1, F.lag("own").over(one)).otherwise(previous)
    t = t.withColumn("begins", ~previous.eqNullSafe(F.col("own"))).withColumn("opened", F.sum(F.col("begins").cast("long")).over(upto))
    if dealt:
        t = _second_carry(t, before, after, history)
    else:
        t = t.withColumns({"w_before": none, "w_all": none, "following": F.lit(None).cast("array<struct<begins:boolean,sum:bigint,n:bigint,window:bigint>>")})
    t = t.withColumn("window", F.col("opened") + F.coalesce("w_before", zero) - 1).withColumn("last", F.coalesce("w_all", F.max("opened").over(here)) - 1)
    # a turn is repeated in the windows that begin within the next `history` turns, while the turns from it on fit
    t = t.withColumn("left", F.count("*").over(here) - F.col("place"))
    copied = []
    for d in range(1, history + 1):
        next_one = F.coalesce(F.lead(F.struct("begins", "sum", "n", "window"), d).over(one), F.when(F.col("left") < d, F.get("following", (F.lit(d - 1) - F.col("left")).cast("int"))))
        t = t.withColumn(f"next{d}", next_one)
        x = F.col(f"next{d}")
        copied.append(F.when(x["begins"] & (x["sum"] - x["n"] - F.col("sum") + F.col("n") <= share), x["window"]))
    again = F.filter(F.array(*copied), lambda w: w.isNotNull()) if history else F.array().cast("array<bigint>")
    t = t.withColumn("again", again)
    # the system turn opens every window; elsewhere it is not history
    system = (F.col("at") == 1) & (F.col("role") == "system")
    again = F.when(system & (F.col("last") > 0), F.sequence(F.lit(1).cast("long"), F.greatest(F.col("last"), F.lit(1).cast("long")))).when(system, F.array().cast("array<bigint>")).otherwise(F.col("again"))
    own = F.array(F.struct(F.col("window").alias("window"), F.lit(False).alias("repeated")))
    copies = F.transform(again, lambda w: F.struct(w.alias("window"), F.lit(True).alias("repeated")))
    t = t.withColumn("copy", F.explode(F.concat(own, copies)))
    return t


def _formatted(t: DataFrame, budget: int, target: str) -> DataFrame:
    """Numbered turns to windows."""
    turn = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    t = t.select("conv_id", "copy.window", F.struct("at", "copy.repeated", turn.alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == target).alias("target"), "n").alias("x"))
    w = t.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list("x")).alias("x"))
    pieces = F.transform("x", lambda x: F.concat(x["head"], x["body"], F.lit(END)))
    # a window's turns are few (its budget over the least tokens of a turn), so the running length is folded here
    spans = F.aggregate(
        "x",
        F.struct(F.lit(0).cast("long").alias("length"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("loss")),
        lambda acc, x: F.struct(
            (acc["length"] + F.length(x["head"]) + F.length(x["body"]) + len(END)).alias("length"),
            F.when(
                x["target"] & ~x["repeated"], F.concat(acc["loss"], F.array(F.struct((acc["length"] + F.length(x["head"])).alias("start"), F.length(x["body"]).cast("long").alias("length"))))
            ).otherwise(acc["loss"]).alias("loss"),
        ),
    )["loss"]
    n = F.aggregate("x", F.lit(0).cast("long"), lambda acc, x: acc + x["n"])
    repeated = F.size(F.filter("x", lambda x: x["repeated"])).cast("long")
    out = w.select("conv_id", "window", repeated.alias("n_repeated"), (F.size("x") - repeated).alias("n_turns"), F.array_join(pieces, "").alias("formatted"), spans.alias("loss"), n.alias("n_tokens"))
    return out.withColumn("over", F.col("n_tokens") > budget)


def read_back(formatted: DataFrame) -> DataFrame:
    """From the output of windows() alone, per conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars.  Repeats are dropped, and escapes undone.

    A digest is over a conversation's whole text, so a conversation's text meets in one row here.
    """
    turns = F.slice(F.split(F.col("formatted"), r"<\|im_start\|>", -1), F.col("n_repeated").cast("int") + 2, F.greatest(F.col("n_turns").cast("int"), F.lit(1)))
    plain = F.transform(
        turns,
        lambda s: F.concat(unescape_role(F.substring_index(s, "\n", 1)), F.lit("\n"), unescape(F.substring(s, F.length(F.substring_index(s, "\n", 1)) + 2, F.length(s) - F.length(F.substring_index(s, "\n", 1)) - 1 - len(END))), F.lit("\n")),
    )
    loss = F.transform("loss", lambda x: unescape(F.substring(F.col("formatted"), (x["start"] + 1).cast("int"), x["length"].cast("int"))))
    w = formatted.select("conv_id", F.struct("window", F.array_join(plain, "").alias("plain"), F.array_join(loss, "").alias("loss")).alias("x"), "n_turns", F.length("formatted").cast("long").alias("chars"))
    c = w.groupBy("conv_id").agg(F.sum("n_turns").alias("n_turns"), F.sort_array(F.collect_list("x")).alias("x"), F.sum("chars").alias("formatted_chars"))
    text = F.array_join(F.transform("x", lambda x: x["plain"]), "")
    under = F.array_join(F.transform("x", lambda x: x["loss"]), "")
    c = c.select("conv_id", "n_turns", text.alias("text"), under.alias("under"), "formatted_chars")
    return c.select("conv_id", "n_turns", F.sha2("text", 256).alias("turns_sha256"), F.length("under").cast("long").alias("loss_chars"), F.sha2("under", 256).alias("loss_sha256"), "formatted_chars")
