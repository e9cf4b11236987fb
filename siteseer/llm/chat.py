"""Chat formatting with Spark expressions only, and the way back.

A conversation becomes one string::

    <|turn|>ROLE<|text|>TEXT<|joint|>TEXT<|end|>...

Adjacent turns of one role share a block; ``<|joint|>`` keeps their border.
Inside roles and texts every ``<|`` is written ``<||``, so a control string
can only come from the template, and undoing it is exact.

``loss`` has an entry per text in order: ``skip`` code points from the end of
the text before (control strings and the role), ``take`` code points of the
escaped text, and ``on``, true where the role is trained on.  Reading checks
every entry against the places where the string has its texts, so a mask that
does not point at them raises an error.

Defined cases: a null role or text is empty; equal turn numbers are ordered
by role and text, null turns come first; repeated rows are repeated turns; a
null ``conv_id`` is one conversation; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, JOINT, END = "<|turn|>", "<|text|>", "<|joint|>", "<|end|>"
LOSS_ROLES = ("assistant",)


def escape(c: Column) -> Column:
    return F.replace(c, F.lit("<|"), F.lit("<||"))


def unescape(c: Column) -> Column:
    return F.replace(c, F.lit("<||"), F.lit("<|"))


def _literal(control: str) -> str:
    return control.replace("|", "\\|")


def format_chats(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_roles=LOSS_ROLES) -> DataFrame:
    """``(conv_id, formatted, loss)``, one row per conversation."""
    s = rows.select(
        F.col(conv_id).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"),
    )
    s = s.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    # adjacent turns of one role become one merged turn with an array of texts
    n = F.size("ts")
    opens = lambda i: (i == 0) | (F.get("ts", i)["role"] != F.get("ts", i - 1)["role"])
    s = s.select("conv_id", "ts", F.filter(F.sequence(F.lit(0), n - 1), opens).alias("at"))
    end = lambda k: F.coalesce(F.get("at", k + 1), n)
    texts = lambda i, k: F.transform(F.slice("ts", i + 1, end(k) - i), lambda x: escape(x["text"]))
    s = s.select("conv_id", F.transform("at", lambda i, k: F.struct(F.get("ts", i)["role"].alias("role"), texts(i, k).alias("bodies"))).alias("ms"))
    block = lambda m: F.concat(F.lit(TURN), escape(m["role"]), F.lit(TEXT), F.array_join(m["bodies"], JOINT), F.lit(END))
    first = lambda m, k: F.when(k == 0, F.lit(0)).otherwise(F.lit(len(END))) + len(TURN) + F.char_length(escape(m["role"])) + len(TEXT)
    mask = lambda m, k: F.transform(m["bodies"], lambda b, i: F.struct(F.when(i == 0, first(m, k)).otherwise(F.lit(len(JOINT))).cast("long").alias("skip"), F.char_length(b).cast("long").alias("take"), m["role"].isin(*loss_roles).alias("on")))
    return s.select("conv_id", F.array_join(F.transform("ms", block), "").alias("formatted"), F.flatten(F.transform("ms", mask)).alias("loss"))


def read_chats(formatted: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(conv_id, turns, loss_texts)`` and the columns in ``keep``, read back from formatted strings and masks."""
    blocks = F.slice(F.split("formatted", _literal(TURN)), 2, 1 << 30)
    s = formatted.select("conv_id", *keep, "loss", F.transform(blocks, lambda b: F.split(F.substring(b, F.lit(1), F.char_length(b) - len(END)), _literal(TEXT))).alias("bs"))
    # what stands before each text: the end of the block before, its own block's head, or a joint
    head = lambda b, k: F.when(k == 0, F.lit(0)).otherwise(F.lit(len(END))) + len(TURN) + F.char_length(F.get(b, F.lit(0))) + len(TEXT)
    one = lambda b, k: F.transform(F.split(F.get(b, F.lit(1)), _literal(JOINT)), lambda t, i: F.struct(unescape(F.get(b, F.lit(0))).alias("role"), t.alias("body"), F.when(i == 0, head(b, k)).otherwise(F.lit(len(JOINT))).alias("skip")))
    s = s.select("conv_id", *keep, "loss", F.flatten(F.transform("bs", one)).alias("ts"))
    wrong = F.exists(F.zip_with("ts", "loss", lambda t, m: ~F.coalesce((t["skip"] == m["skip"]) & (F.char_length(t["body"]) == m["take"]), F.lit(False))), lambda x: x)
    checked = F.when(wrong, F.raise_error(F.lit("a loss mask that does not point at the texts"))).otherwise(F.col("ts"))
    s = s.select("conv_id", *keep, "loss", checked.alias("ts"))
    on = F.filter("ts", lambda t, i: F.get("loss", i)["on"])
    return s.select("conv_id", *keep, F.transform("ts", lambda t: F.struct(t["role"].alias("role"), unescape(t["body"]).alias("text"))).alias("turns"), F.transform(on, lambda t: unescape(t["body"])).alias("loss_texts"))
