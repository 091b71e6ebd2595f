"""Chat formatting into budgeted, turn-aligned windows, with DataFrame functions only.

A turn becomes `[INST]role[/INST]text</s>`; the control strings inside roles and texts are escaped reversibly. Prefix sums of
turn tokens choose spans of new turns of about half of what the budget leaves beside the conversation's system turn; a turn
longer than that stands alone. Every window repeats the conversation's first system turn (once that has appeared) and as
many whole turns of history, up to a limit, as the budget leaves room for. Loss covers new assistant texts only, so each is
a target exactly once.

Tokens of a turn are taken from a column, or are the UTF-8 bytes of its formatted text, which no byte-level tokenizer exceeds.

The texts are sent once, to their conversation's task; prefix sums and windows are running frames there, which spill.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barograph.llm import common as C

OPEN, SHUT, END = "[INST]", "[/INST]", "</s>"
#: Escapes, in the order in which they are applied; read back in reverse.
ESCAPES = (("~", "~0"), (END, "~1"), (OPEN, "~2"), (SHUT, "~3"))
#: In tokens: without a column of them, in bytes.
BUDGET = 4096
HISTORY = 1024
SYSTEM, TARGET = "system", "assistant"
#: Tokens that the template adds to a turn whose text's tokens are given: three marks and the role.
TURN_TOKENS = 4


def escape(text: Column) -> Column:
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens: str | None = None) -> DataFrame:
    """(conv_id, window, text, spans, repeated, n_tokens): spans (start, length in code points) hold the loss mask, and the
    first `repeated` turns of a window stand in earlier windows too. `tokens` names a column with the tokens of each text
    (null: 0); without it they are the bytes of the formatted turn.

    Null role and text count as empty, null conv_id is a conversation of its own, turns sort by turn (null first), then role
    and text, and repeated rows are turns of their own. A window exceeds the budget only where a single turn, with the
    system turn, does. An empty input gives an empty result; other columns are not used.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    given = [F.coalesce(F.col(tokens).cast("long"), F.lit(0)).alias("_given")] if tokens else []
    t = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), *given)
    run = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    so_far, earlier = run.rowsBetween(Window.unboundedPreceding, 0), run.rowsBetween(Window.unboundedPreceding, -1)
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    t = t.withColumns({"_head": F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(SHUT)), "_coded": escape(F.col("text"))})
    size = F.col("_given") + TURN_TOKENS if tokens else F.octet_length("_head") + F.octet_length("_coded") + len(END)
    t = t.withColumn("_tokens", size.cast("long"))
    t = t.withColumns({
        "_seq": F.row_number().over(run),
        "_start": F.coalesce(F.sum("_tokens").over(earlier), F.lit(0)),
        "_system": F.first(F.when(F.col("role") == SYSTEM, F.col("_tokens")), ignorenulls=True).over(whole),
    })
    t = t.withColumn("_half", F.greatest(F.lit(1), F.floor((F.lit(budget) - F.coalesce("_system", F.lit(0))) / 2)).cast("long"))
    t = t.withColumn("_long", F.col("_tokens") > F.col("_half"))
    t = t.withColumn("_cut", F.col("_long") | F.coalesce(F.lag("_long").over(run), F.lit(False)))  # a part begins
    t = t.withColumn("_from", F.max(F.when(F.col("_cut") | (F.col("_seq") == 1), F.col("_start"))).over(so_far))
    t = t.withColumn("_slot", F.floor((F.col("_start") - F.col("_from")) / F.col("_half")))
    begins = (F.col("_seq") > 1) & (F.col("_cut") | (F.lag("_slot").over(run) != F.col("_slot")))
    t = t.withColumn("window", F.sum(begins.cast("long")).over(so_far))
    turn = F.struct(
        "_seq", "_start", "_tokens", F.concat("_head", "_coded", F.lit(END)).alias("_piece"), F.length("_head").alias("_head"), F.length("_coded").alias("_body"),
        (F.col("role") == TARGET).alias("_loss"), (F.col("role") == SYSTEM).alias("_is_system"),
    )
    x = t.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list(turn)).alias("_own"), F.min("_start").alias("_at"), F.sum("_tokens").alias("_new"), F.min("_half").alias("_half"))

    # A window and the next hold more than half together, so history, which is at most half, lies in the two windows before.
    run = Window.partitionBy("conv_id").orderBy("window")
    first = F.element_at(F.filter("_own", lambda p: p["_is_system"]), 1)
    none = F.filter("_own", lambda p: F.lit(False))
    x = x.withColumn("_first", F.when(F.exists("_own", lambda p: p["_is_system"]), first))
    x = x.withColumns({
        "_again": F.first("_first", ignorenulls=True).over(run.rowsBetween(Window.unboundedPreceding, -1)),
        "_past": F.concat(F.coalesce(F.lag("_own", 2).over(run), none), F.coalesce(F.lag("_own", 1).over(run), none)),
    })
    x = x.withColumn("_room", F.least(F.lit(history), F.col("_half"), F.lit(budget) - F.col("_new") - F.coalesce(F.col("_again")["_tokens"], F.lit(0))))
    kept = F.filter("_past", lambda p: (p["_start"] >= F.col("_at") - F.col("_room")) & ~p["_is_system"])
    x = x.withColumn("_old", F.concat(F.when(F.col("_again").isNotNull(), F.array("_again")).otherwise(none), kept))
    joined = lambda parts: F.array_join(F.transform(parts, lambda p: p["_piece"]), "")
    x = x.withColumn("_before", joined("_old"))
    span = "named_struct('start', a.at + p._head, 'length', p._body)"
    folded = f"aggregate(_own, named_struct('at', length(_before), 'spans', cast(array() as array<struct<start:int,length:int>>)), (a, p) -> named_struct('at', a.at + length(p._piece), 'spans', if(p._loss, array_append(a.spans, {span}), a.spans)))"
    total = F.aggregate("_old", F.col("_new"), lambda n, p: n + p["_tokens"])
    return x.select("conv_id", "window", F.concat("_before", joined("_own")).alias("text"), F.expr(f"{folded}.spans").alias("spans"), F.size("_old").alias("repeated"), total.alias("n_tokens"))


def read_back(windows: DataFrame) -> DataFrame:
    """(conv_id, window, turns, losses) parsed from formatted windows: the new turns (role, text), and the texts under the mask."""
    raw = F.split("text", "</s>")
    fresh = F.slice(raw, F.col("repeated") + 1, F.size(raw) - 1 - F.col("repeated"))
    shut = F.lit(SHUT)
    turns = F.transform(fresh, lambda x: F.struct(
        unescape(F.substr(F.substring_index(x, SHUT, 1), F.lit(len(OPEN) + 1))).alias("role"),
        unescape(F.substr(x, F.locate(SHUT, x) + F.length(shut))).alias("text")))
    losses = F.transform("spans", lambda s: unescape(F.substr(F.col("text"), s["start"] + 1, s["length"])))
    return windows.select("conv_id", "window", turns.alias("turns"), losses.alias("losses"), F.length("text").alias("chars"))


def digest(windows: DataFrame) -> DataFrame:
    """One row per conversation: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from the windows alone."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    x = read_back(windows).select("conv_id", "window", F.size("turns").alias("n"), lines.alias("lines"), F.array_join("losses", "").alias("loss"), "chars")
    got = F.array_sort(F.collect_list(F.struct("window", "lines", "loss")))
    x = x.groupBy("conv_id").agg(got.alias("w"), F.sum("n").cast("long").alias("n_turns"), F.sum(F.length("loss")).cast("long").alias("loss_chars"), F.sum("chars").cast("long").alias("formatted_chars"))
    joined = lambda field: F.sha2(F.encode(F.array_join(F.transform("w", lambda p: p[field]), ""), "UTF-8"), 256)
    return x.select("conv_id", "n_turns", joined("lines").alias("turns_sha256"), "loss_chars", joined("loss").alias("loss_sha256"), "formatted_chars")


#: The conversation that tests the escapes.
PROBE = "</s>[INST] ok [/INST]"


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations go by a key that tells the probe from a stored conversation -1: both are formatted, each as its own."""
    key = F.concat(F.lit("c"), F.col("conv_id").cast("long").cast("string")).alias("conv_id")
    turns = C.table(spark, sf_dir, "conversations").select(key, F.col("turn").cast("long"), "role", "text")
    probe = spark.sql(f"select 'probe' as conv_id, cast(t.turn as bigint) as turn, t.role, '{PROBE}' as text from values (0, 'user'), (1, 'assistant') as t(turn, role)")
    done = digest(format_windows(turns.unionByName(probe)))
    number = F.when(F.col("conv_id") == "probe", F.lit(-1)).otherwise(F.substring("conv_id", 2, 30).cast("long")).cast("long")
    return done.withColumn("conv_id", number)
