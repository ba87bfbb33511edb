r"""Chat formatting with budgeted, turn-aligned windows.

A turn is written ``<|turn|>role<|text|>text<|end|>``. Control strings that stand in a role or text (these
three and ``<s> </s> [INST] [/INST]``) get a backslash after their first character, one more than they had:
``<\|end|>`` is read back as ``<|end|>``. Every such string in a formatted text is therefore markup.

Windows: prefix sums of turn tokens along a conversation choose the spans. Turn i starts at E(i), the
tokens before it; a turn that lies within one stretch of ``budget`` tokens belongs to that stretch's span, a
turn that crosses a border is a span of its own. So no span of several turns exceeds the budget and no turn is
cut. Each window holds the conversation's system turn, at most ``history`` tokens of the turns before the
span (repeated context), and the span's turns. Only assistant turns of the span are under the loss mask;
repeated ones are masked. All of it is window functions over one shuffle by conversation plus one grouping by
(conversation, span); a span's rows are bounded by the budget.

Defined results: null text or role is empty; rows with equal turn numbers go by role, then text; a null turn
comes first; a null conversation id is a conversation of its own; repeated rows are repeated turns; an
empty table gives no windows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Fixed: what may follow the first character of a control string.
_REST = r"\|(?:turn|text|end)\|>|/?s>|/?INST\]"
#: Tokens of new turns in a window, and of repeated turns before them.
BUDGET, HISTORY = 1024, 256


def escape(c: Column) -> Column:
    return F.regexp_replace(c, rf"([<\[])(\\*)({_REST})", r"$1$2\\$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, rf"([<\[])\\(\\*)({_REST})", "$1$2$3")


def turn_tokens(text: Column) -> Column:
    """Estimate of a turn's tokens: a quarter of its characters and four for its marks."""
    return (F.ceil(F.char_length(text) / 4) + 4).cast("long")


def format_windows(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Windows: conv_id, span, formatted, n_repeated (leading turns that are not the span's), loss_spans.

    ``loss_spans`` has the (start, length) in code points of the formatted text that are trained on, start
    from 0. ``span`` grows along the conversation.
    """
    empty = F.lit("")
    rows = turns.select(
        F.col(f"`{conv}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), empty).alias("role"), F.coalesce(F.col(f"`{text}`"), empty).alias("text")
    ).withColumn("tokens", turn_tokens(F.col("text")))
    along = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    placed = rows.withColumn("no", F.row_number().over(along)).withColumn("end", F.sum("tokens").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.withColumn("start", F.col("end") - F.col("tokens"))
    first, last = F.floor(F.col("start") / budget), F.floor((F.col("end") - 1) / budget)
    piece = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT), escape(F.col("text")), F.lit(END))
    placed = placed.withColumn("span", F.when(first == last, first * 2).otherwise(first * 2 + 1)).withColumn("piece", piece)
    # A crossing turn may stand between two spans of equal stretch only if it is the last that starts there, so spans grow along the turns.
    by_no = Window.partitionBy("conv_id").orderBy("no")
    placed = placed.withColumn("system", F.first(F.when(F.col("role") == "system", F.struct("no", "piece")), ignorenulls=True).over(by_no))
    opens = F.coalesce(F.lag("span").over(by_no) != F.col("span"), F.lit(True))
    placed = placed.withColumn("opens", opens)
    back = Window.partitionBy("conv_id").orderBy("start").rangeBetween(-history, -1)
    placed = placed.withColumn("before", F.when(F.col("opens"), F.collect_list(F.struct("no", "piece")).over(back)))
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT))
    each = F.struct("no", "piece", (F.col("role") == "assistant").alias("loss"), F.char_length(head).alias("head"))
    spans = placed.groupBy("conv_id", "span").agg(
        F.array_sort(F.collect_list(each)).alias("own"), F.max("system").alias("system"), F.max(F.when(F.col("opens"), F.struct("no", "before"))).alias("opening")
    )
    earlier = F.filter(F.coalesce(F.col("opening.before"), F.array()), lambda t: F.col("system.no").isNull() | (t["no"] > F.col("system.no")))
    kept = F.when(F.col("system.no") < F.col("opening.no"), F.array(F.col("system"))).otherwise(F.array().cast("array<struct<no:int,piece:string>>"))
    spans = spans.withColumn("repeated", F.concat(kept, F.array_sort(earlier)))
    lead = F.array_join(F.transform("repeated", lambda t: t["piece"]), "")
    spans = spans.withColumn("lead", lead).withColumn("n_repeated", F.size("repeated"))
    zero = F.struct(F.char_length("lead").cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))
    marks = F.aggregate(
        "own",
        zero,
        lambda acc, t: F.struct(
            (acc["at"] + F.char_length(t["piece"])).alias("at"),
            F.when(
                t["loss"],
                F.concat(acc["spans"], F.array(F.struct((acc["at"] + t["head"]).cast("long").alias("start"), (F.char_length(t["piece"]) - t["head"] - len(END)).cast("long").alias("length")))),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    formatted = F.concat("lead", F.array_join(F.transform("own", lambda t: t["piece"]), ""))
    return spans.select("conv_id", "span", formatted.alias("formatted"), "n_repeated", marks["spans"].alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text: array of struct(role, text), unescaped."""
    pattern = r"(?s)<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>"
    roles, texts = (F.regexp_extract_all(formatted, F.lit(pattern), F.lit(i)) for i in (1, 2))
    return F.transform(F.arrays_zip(roles.alias("role"), texts.alias("text")), lambda t: F.struct(unescape(t["role"]).alias("role"), unescape(t["text"]).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def read_back(windows: DataFrame) -> DataFrame:
    """Per conversation what its windows hold: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Each window is parsed by itself and becomes one string of its turns and one of its loss text; a hash of
    a whole conversation needs these in one place, so one row of it is as long as the conversation.
    """
    turns = F.slice("turns", F.col("n_repeated") + 1, F.greatest(F.size("turns") - F.col("n_repeated"), F.lit(0)))
    nl = F.lit("\n")
    parsed = windows.withColumn("turns", read_turns(F.col("formatted"))).select(
        "conv_id",
        "span",
        F.size(turns).alias("n"),
        F.array_join(F.transform(turns, lambda t: F.concat(t["role"], nl, t["text"], nl)), "").alias("said"),
        read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"),
        F.char_length("formatted").cast("long").alias("chars"),
    )
    whole = parsed.groupBy("conv_id").agg(F.sum("n").cast("long").alias("n_turns"), F.array_sort(F.collect_list(F.struct("span", "said", "loss"))).alias("w"), F.sum("chars").alias("formatted_chars"))
    said, loss = F.array_join("w.said", ""), F.array_join("w.loss", "")
    return whole.select("conv_id", "n_turns", F.sha2(said, 256).alias("turns_sha256"), F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: all conversations and conversation -1, formatted and read back."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return read_back(format_windows(turns.unionByName(more)))


#: The same in DuckDB: turns in order, their spans, and of each span's context the characters alone.
ORACLE = rf"""WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS no, CAST(ceil(len(text) / 4) AS BIGINT) + 4 AS tokens,
  {len(TURN) + len(TEXT) + len(END)} + len(regexp_replace(role, '([<\[])(\\*)({_REST})', '\1\2\\\3', 'g')) + len(regexp_replace(text, '([<\[])(\\*)({_REST})', '\1\2\\\3', 'g')) AS chars FROM said),
p AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY no) - tokens AS start FROM t),
s AS (SELECT *, CASE WHEN start // {BUDGET} = (start + tokens - 1) // {BUDGET} THEN start // {BUDGET} * 2 ELSE start // {BUDGET} * 2 + 1 END AS span FROM p),
y AS (SELECT conv_id, min(no) AS no, arg_min(chars, no) AS chars FROM s WHERE role = 'system' GROUP BY conv_id),
w AS (SELECT conv_id, span, min(no) AS opening, max(no) AS closing, min(start) AS start, sum(chars) AS own FROM s GROUP BY conv_id, span),
v AS (SELECT w.*, y.no AS sys, y.chars AS sys_chars FROM w LEFT JOIN y ON w.conv_id IS NOT DISTINCT FROM y.conv_id AND y.no <= w.closing),
f AS (SELECT v.conv_id, v.span, any_value(v.own) + any_value(CASE WHEN v.sys < v.opening THEN v.sys_chars ELSE 0 END) + coalesce(sum(s.chars), 0) AS chars
  FROM v LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM v.conv_id AND s.start BETWEEN v.start - {HISTORY} AND v.start - 1 AND (v.sys IS NULL OR s.no > v.sys) GROUP BY v.conv_id, v.span),
c AS (SELECT conv_id, CAST(sum(chars) AS BIGINT) AS formatted_chars FROM f GROUP BY conv_id),
a AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY no)) AS turns_sha256,
  coalesce(string_agg(text, '' ORDER BY no) FILTER (WHERE role = 'assistant'), '') AS loss FROM t GROUP BY conv_id)
SELECT a.conv_id, n_turns, turns_sha256, CAST(len(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM a JOIN c ON a.conv_id IS NOT DISTINCT FROM c.conv_id"""
