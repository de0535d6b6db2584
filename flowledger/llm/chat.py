"""Chat formatting in budgeted windows, of DataFrame functions alone.

A conversation becomes one or more windows of at most ``budget`` tokens. Prefix sums of the turns' tokens choose spans of
whole turns; a later window begins with the conversation's system turn and with as much of the turns just before it as fits
``history`` tokens and ``turns`` turns. What is repeated is context only: the loss mask covers the text of each assistant
turn once, in the window that it is new in.

Turns are put in order by ranges over all conversations, and numbered by sections of at most ``SECTION`` rows; spans are
chosen in blocks of at most ``BLOCK`` turns, so that a conversation of any length is spread over tasks.

The template's marks are control strings. In texts and names of roles a backslash goes behind the first character of what
looks like one, or like one with backslashes there, so no text holds a mark and each is read back as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowledger.llm.scratch import keep

BUDGET, HISTORY, TURNS = 2048, 512, 4
#: Tokens that a turn's marks count for.
MARKS = 4
#: Rows that are numbered together, and turns in which spans are chosen together; a window ends with its block.
SECTION, BLOCK = 4096, 1024

#: The marks around a turn's text by its role; any other role is named between the first two of OTHER.
TEMPLATE = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("[TURN]", "[:]", "[/TURN]")
_REST = r"(/?(?:INST|TURN)\]|:\]|/?s>|</?SYS>>)"
_TURN = r"(?s)<<SYS>>.*?<</SYS>>|\[INST\] .*? \[/INST\]|<s>.*?</s>|\[TURN\].*?\[/TURN\]"
#: About a token of a byte-pair vocabulary: up to five letters or three digits, or one other character.
TOKEN = r"[\p{L}\p{M}]{1,5}|\p{N}{1,3}|[^\p{L}\p{M}\p{N}\x20\x09-\x0D]"


def tokens(text: Column) -> Column:
    """The number of tokens of a text, estimated, those of its marks included."""
    return F.regexp_count(text, F.lit(TOKEN)) + MARKS


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"([\[<])(\\*)" + _REST), F.lit(r"$1\\$2$3"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"([\[<])\\(\\*)" + _REST), F.lit("$1$2$3"))


def marked(role: Column, body: Column) -> Column:
    """A turn in its marks; ``body`` is escaped."""
    out = None
    for name, (head, tail) in TEMPLATE.items():
        out = (F if out is None else out).when(role == name, F.concat(F.lit(head), body, F.lit(tail)))
    return out.otherwise(F.concat(F.lit(OTHER[0]), escaped(role), F.lit(OTHER[1]), body, F.lit(OTHER[2])))


def read_turns(text: Column) -> Column:
    """The turns of a formatted text as an array of (role, text), unescaped."""

    def turn(x: Column) -> Column:
        out = None
        for name, (head, tail) in TEMPLATE.items():
            inner = F.substr(x, F.lit(len(head) + 1), F.char_length(x) - len(head) - len(tail))
            out = (F if out is None else out).when(F.startswith(x, F.lit(head)), F.struct(F.lit(name).alias("role"), unescaped(inner).alias("text")))
        both = F.split(F.substr(x, F.lit(len(OTHER[0]) + 1), F.char_length(x) - len(OTHER[0]) - len(OTHER[2])), r"\[:\]", 2)
        return out.otherwise(F.struct(unescaped(both[0]).alias("role"), unescaped(both[1]).alias("text")))

    return F.transform(F.regexp_extract_all(text, F.lit(_TURN), F.lit(0)), turn)


def read_loss(text: Column, loss: Column) -> Column:
    """The texts under the loss mask of a formatted text, unescaped, one after the other."""
    return F.array_join(F.transform(loss, lambda s: unescaped(F.substr(text, s["start"] + 1, s["length"]))), "")


def _placed(rows: DataFrame, conv: str, turn: str, role: str, text: str, count) -> DataFrame:
    """(conv, id, part, body, role, tokens): formatted turns with ids that rise in the order of conversations and turns."""
    own = rows.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    order = ["conv", "turn", "role", "hash", "tie"]  # the last only splits rows that are equal throughout
    dealt = own.withColumns({"hash": F.xxhash64("text"), "tie": F.monotonically_increasing_id()}).repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = dealt.select("conv", "role", "text", F.monotonically_increasing_id().alias("id"))
    body = escaped(F.col("text"))
    done = numbered.select("conv", "id", "role", marked(F.col("role"), body).alias("part"), F.when(F.col("role") == "assistant", F.char_length(body)).otherwise(0).alias("loss"), count(F.col("text")).cast("long").alias("tokens"))
    return keep(done, "turns")


def _positions(placed: DataFrame) -> DataFrame:
    """(conv, id, tokens, system, pos): the place of each turn in its conversation, from 0."""
    slim = placed.select("conv", "id", "tokens", (F.col("role") == "system").alias("system"), F.call_function("div", "id", F.lit(SECTION)).alias("section"))
    before = Window.partitionBy("conv").orderBy("section").rowsBetween(Window.unboundedPreceding, -1)
    sections = slim.groupBy("conv", "section").agg(F.count("*").alias("n")).withColumn("base", F.sum("n").over(before))
    later = sections.where("base is not null").select(F.col("conv").alias("c"), F.col("section").alias("s"), "base")  # one for a section at most
    own = slim.withColumn("k", F.row_number().over(Window.partitionBy("conv", "section").orderBy("id")) - 1)
    both = own.join(later, F.col("conv").eqNullSafe(F.col("c")) & (F.col("section") == F.col("s")), "left")
    return both.select("conv", "id", "tokens", "system", (F.col("k") + F.coalesce("base", F.lit(0))).alias("pos"))


def _spans(budget: int, history: int, turns: int) -> Column:
    """Spans of a block's new turns as (i, h): first turn and number of repeated ones before it."""

    def before(x: Column) -> Column:
        near = F.slice("turns", F.greatest(F.lit(1), x["i"] - turns), F.least(F.lit(turns), x["i"] - 1))
        room = F.least(F.lit(history), F.lit(budget) - F.col("fixed") - x["tokens"])
        return F.filter(near, lambda t: (t["pos"] >= F.col("first")) & (x["sum"] - t["sum"] <= room))

    def step(acc: Column, x: Column) -> Column:
        past = before(x)
        repeated = F.when(x["pos"] > 0, F.col("fixed")).otherwise(0) + F.coalesce(F.array_max(F.transform(past, lambda t: x["sum"] - t["sum"])), F.lit(0))
        new = F.struct(F.concat(acc["spans"], F.array(F.struct(x["i"].alias("i"), F.size(past).alias("h")))).alias("spans"), (x["sum"] - repeated).cast("long").alias("from"))
        return F.when((F.size(acc["spans"]) > 0) & (x["sum"] + x["tokens"] - acc["from"] <= budget), acc).otherwise(new)

    start = F.struct(F.array().cast("array<struct<i: int, h: int>>").alias("spans"), F.lit(0).cast("long").alias("from"))
    return F.aggregate(F.filter("turns", lambda x: x["new"]), start, step, lambda acc: acc["spans"])


def windows(rows: DataFrame, budget: int = BUDGET, history: int = HISTORY, turns: int = TURNS, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", count=tokens) -> DataFrame:
    """(conversation, first_turn, n_turns, n_repeated, n_tokens, text, loss) for each window.

    ``first_turn`` counts from 0, ``n_turns`` are the window's new turns, behind ``n_repeated`` ones; ``loss`` are spans
    (start, length) of characters in ``text``. ``count`` gives a text's tokens as a column. A turn that doesn't fit the
    budget with the system turn has a window of its own, whole, with the system turn alone before it.

    Turns go by ``turn``, null first, then role, then hash of the text; repeated rows are turns each. A null conversation
    is one too. A null text is empty, a null role is the role of no name. An empty table gives no rows. Other columns are
    not looked at.
    """
    placed = _placed(rows, conv, turn, role, text, count)
    at = keep(_positions(placed), "positions")
    head = at.where("pos = 0 and system").select(F.col("conv").alias("c"), F.col("id").alias("head"), F.col("tokens").alias("fixed"))
    block = F.call_function("div", "pos", F.lit(BLOCK))
    near = F.when(F.col("pos") % BLOCK >= BLOCK - turns, F.array(block, block + 1)).otherwise(F.array(block))  # the next block may repeat them
    dealt = at.withColumn("block", F.explode(near))
    w = Window.partitionBy("conv", "block").orderBy("pos")
    dealt = dealt.withColumns({"i": F.row_number().over(w), "sum": F.coalesce(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "new": block == F.col("block")})
    blocks = dealt.groupBy("conv", "block").agg(F.array_sort(F.collect_list(F.struct("i", "pos", "id", "tokens", "sum", "new"))).alias("turns"))  # BLOCK turns and some
    blocks = blocks.join(head, F.col("conv").eqNullSafe(F.col("c")), "left").withColumns({"first": F.when(F.col("head").isNull(), 0).otherwise(1), "fixed": F.coalesce("fixed", F.lit(0))})
    spans = blocks.withColumn("spans", _spans(budget, history, turns)).select("*", F.posexplode("spans").alias("k", "span"))
    end = F.coalesce(F.try_element_at("spans", F.col("k") + 2)["i"], F.size("turns") + 1)
    own = F.slice("turns", F.col("span.i") - F.col("span.h"), end - F.col("span.i") + F.col("span.h"))
    start = F.col("turns")[F.col("span.i") - 1]["pos"]
    members = F.transform(own, lambda t: F.struct(t["pos"].alias("pos"), t["id"].alias("id"), (t["pos"] >= start).alias("new")))
    system = F.array(F.struct(F.lit(0).cast("long").alias("pos"), F.col("head").alias("id"), F.lit(False).alias("new")))
    members = F.when(F.col("head").isNotNull() & (start > 0), F.concat(system, members)).otherwise(members)
    found = spans.select("conv", start.alias("first_turn"), F.explode(members).alias("m")).select("conv", "first_turn", "m.*")
    parts = found.join(placed.select("id", "part", "loss", "tokens"), "id")
    whole = parts.groupBy("conv", "first_turn").agg(F.array_sort(F.collect_list(F.struct("pos", "new", "part", "loss"))).alias("parts"), F.sum("tokens").alias("n_tokens"), F.count_if("new").alias("n_turns"), F.count_if(~F.col("new")).alias("n_repeated"))

    def masked(acc: Column, x: Column) -> Column:
        span = F.array(F.struct((acc["at"] + len(TEMPLATE["assistant"][0])).alias("start"), x["loss"].alias("length")))
        spans_ = F.when(x["new"] & (x["loss"] > 0), F.concat(acc["spans"], span)).otherwise(acc["spans"])
        return F.struct((acc["at"] + F.char_length(x["part"])).alias("at"), spans_.alias("spans"))

    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, length: int>>").alias("spans"))
    loss = F.aggregate("parts", none, masked, lambda acc: acc["spans"])
    return whole.select(F.col("conv").alias(conv), "first_turn", "n_turns", "n_repeated", "n_tokens", F.array_join(F.transform("parts", lambda x: x["part"]), "").alias("text"), loss.alias("loss"))


def digests(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """What windows say of each conversation when they are read back: turns, texts under the loss mask, characters."""
    turns = F.slice(read_turns(F.col("text")), F.col("n_repeated") + 1, F.greatest(F.col("n_turns"), F.lit(1)))
    spoken = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = formatted.select(F.col(f"`{conv}`").alias("conv"), "first_turn", F.size(turns).alias("n"), F.char_length("text").cast("long").alias("chars"), spoken.alias("spoken"), read_loss(F.col("text"), F.col("loss")).alias("loss"))
    one = read.groupBy("conv").agg(F.sum("n").cast("long").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.array_sort(F.collect_list(F.struct("first_turn", "spoken", "loss"))).alias("w"))
    joined = {c: F.array_join(F.col("w").getField(c), "") for c in ("spoken", "loss")}
    return one.select(
        F.col("conv").alias(conv), "n_turns", F.sha2(joined["spoken"], 256).alias("turns_sha256"),
        F.char_length(joined["loss"]).cast("long").alias("loss_chars"), F.sha2(joined["loss"], 256).alias("loss_sha256"), "formatted_chars",
    )
