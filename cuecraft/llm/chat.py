"""Chat formatting from event logs: streamed deltas, edits and regenerations become final messages, then one text a conversation.

DataFrame functions only. A conversation's log is dealt to one task and sorted; window functions fold it
row by row and spill, so a conversation with very many events costs disk, not memory, until its
final text is put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The template. Every control string begins with ``<`` or ``[`` and holds neither again.
USER, ASSISTANT = ("[INST]", "[/INST]"), ("<s>", "</s>")
OTHER, SAYS = ("[ROLE]", "[/ROLE]"), "[SAYS]"
_TAIL = r"(/?s>|/?INST\]|/?ROLE\]|SAYS\])"
TURN = r"(?s)\[INST\].*?\[/INST\]|<s>.*?</s>|\[ROLE\].*?\[/ROLE\]"
#: Code points of one streamed delta in a log made of finished conversations.
DELTA = 256


def escaped(text: Column) -> Column:
    """One backslash more behind the first character of what is, or looks like, a control string."""
    return F.regexp_replace(text, r"([<\[])(\\*)" + _TAIL, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _TAIL, "$1$2$3")


def reconstruct(log: DataFrame) -> DataFrame:
    """Final messages (conv_id, message, role, text) of a log (conv_id, seq, message, kind, role, text).

    A conversation's events count in the order of seq. ``message`` opens a message with a text or
    sets it anew, ``delta`` appends, ``edit`` replaces the text and ``regenerate`` clears it and
    takes back all messages with higher numbers that were there. A message's role is the last that
    one of its events names, else empty. Other kinds, null too, are deltas.

    Events equal in every column are one event that was delivered twice. Events with one seq count
    in the order of message, kind, role and text; a null seq or message comes first, a null conv_id is a
    conversation like others, a null text is empty. An empty log gives an empty result; further columns
    are left out. Both folds run over one exchange by conv_id: the sort within it differs alone.
    """
    rows = log.select("conv_id", "seq", "message", "kind", "role", F.coalesce("text", F.lit("")).alias("text"))
    backward = [F.col("seq").desc(), F.col("message").desc(), F.col("kind").desc(), F.col("role").desc(), F.col("text").desc()]
    conversation = Window.partitionBy("conv_id").orderBy(*backward)
    later = conversation.rowsBetween(Window.unboundedPreceding, -1)
    same = F.lit(True)
    for name in ("seq", "message", "kind", "role", "text"):
        same = same & F.lag(name).over(conversation).eqNullSafe(F.col(name))
    second = F.coalesce(same & (F.row_number().over(conversation) > 1), F.lit(False))
    kept_to = F.min(F.when(F.col("kind") == "regenerate", F.col("message"))).over(later)
    rows = rows.withColumn("__gone", second | F.coalesce(F.col("message") > kept_to, F.lit(False))).filter("NOT __gone")
    own = Window.partitionBy("conv_id", "message").orderBy(*backward)
    resets = F.col("kind").isin("message", "edit", "regenerate")
    over = F.count_if(F.coalesce(resets, F.lit(False))).over(own.rowsBetween(Window.unboundedPreceding, -1))
    role = F.first("role", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    text = F.when(F.col("kind") == "regenerate", F.lit("")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "message", F.coalesce(role, F.lit("")).alias("role"), text.alias("text"), (-F.row_number().over(own)).alias("__k"), over.alias("__over"))
    pieces = F.array_sort(F.collect_list(F.when(F.col("__over") == 0, F.struct("__k", "text"))))
    return rows.groupBy("conv_id", "message").agg(F.first("role").alias("role"), F.array_join(F.transform(pieces, lambda p: p["text"]), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """Per conversation (conv_id, formatted, turn_spans): its messages, in the order of their numbers, as one text.

    A user's text stands in [INST] and [/INST], an assistant's in <s> and </s>, others behind their role in
    [ROLE], [SAYS] and [/ROLE]. Control strings inside texts and roles are escaped reversibly. turn_spans
    tells for each turn, in code points of ``formatted``, where the turn and its text begin and end and
    whether the text is under the loss mask (assistants' are). Null roles and texts are empty; a null number
    comes first, equal ones in the order of role and text. A conversation is one string of the
    result, so it is put together in one task and has to fit into one.
    """
    role, text = F.coalesce("role", F.lit("")), escaped(F.coalesce("text", F.lit("")))
    loss = role == "assistant"
    head = F.when(role == "user", USER[0]).when(loss, ASSISTANT[0]).otherwise(F.concat(F.lit(OTHER[0]), escaped(role), F.lit(SAYS)))
    foot = F.when(role == "user", USER[1]).when(loss, ASSISTANT[1]).otherwise(F.lit(OTHER[1]))
    own = Window.partitionBy("conv_id").orderBy(F.col("message").asc_nulls_first(), "role", "text")
    rows = messages.select("conv_id", "message", "role", "text", head.alias("__head"), text.alias("__text"), foot.alias("__foot"), loss.alias("__loss"))
    long = lambda name: F.length(name).cast("long")
    end = F.sum(long("__head") + long("__text") + long("__foot")).over(own.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.select("conv_id", F.row_number().over(own).alias("__k"), "__head", "__text", "__foot", "__loss", end.alias("__end"))
    text_end = F.col("__end") - long("__foot")
    text_start = text_end - long("__text")
    span = F.struct((text_start - long("__head")).alias("start"), text_start.alias("text_start"), text_end.alias("text_end"), F.col("__end").alias("end"), F.col("__loss").alias("loss"))
    turn = F.struct("__k", F.concat("__head", "__text", "__foot").alias("piece"), span.alias("span"))
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("__turns"))
    return turns.select("conv_id", F.array_join(F.transform("__turns", lambda t: t["piece"]), "").alias("formatted"), F.transform("__turns", lambda t: t["span"]).alias("turn_spans"))


def read_chat(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns array<struct<role, text>>, loss_text) read from ``formatted`` and ``turn_spans`` alone.

    Turns are found by their control strings, the text under the loss mask by the spans, each cut from its
    own turn so that the work grows with the text and not with its square. Null or empty texts have no turns.
    """
    width = F.length(F.lit(OTHER[0]))

    def turn(x: Column) -> Column:
        other = x.startswith(OTHER[0])
        says = F.instr(x, SAYS)
        role = F.when(x.startswith(USER[0]), "user").when(x.startswith(ASSISTANT[0]), "assistant").otherwise(unescaped(F.substring(x, width + 1, says - width - 1)))
        head = F.when(other, says - 1 + len(SAYS)).when(x.startswith(USER[0]), len(USER[0])).otherwise(len(ASSISTANT[0]))
        foot = F.when(other, len(OTHER[1])).when(x.startswith(USER[0]), len(USER[1])).otherwise(len(ASSISTANT[1]))
        return F.struct(role.alias("role"), unescaped(F.substring(x, head + 1, F.length(x) - head - foot)).alias("text"))

    blocks = formatted.select("conv_id", "formatted", "turn_spans", F.regexp_extract_all(F.coalesce("formatted", F.lit("")), F.lit(TURN), F.lit(0)).alias("__blocks"))
    masked = F.filter(F.arrays_zip(F.col("__blocks").alias("block"), F.col("turn_spans").alias("span")), lambda z: z["span"]["loss"])
    trained = F.transform(masked, lambda z: unescaped(F.substring(z["block"], (z["span"]["text_start"] - z["span"]["start"] + 1).cast("int"), (z["span"]["text_end"] - z["span"]["text_start"]).cast("int"))))
    return blocks.select("conv_id", "formatted", F.transform("__blocks", turn).alias("turns"), F.coalesce(F.array_join(trained, ""), F.lit("")).alias("loss_text"))


def as_log(conversations: DataFrame, delta: int = DELTA) -> DataFrame:
    """The log of finished conversations (conv_id, turn, role, text), as a chat service would have written it.

    Messages are the rows in the order of turn (null first), role and text. An assistant's is streamed twice: a draft
    of one delta, a regeneration, then all deltas of at most ``delta`` code points. Others are sent with
    their first ``delta`` code points and edited to the whole text where that is longer. Null roles and texts are empty.
    """
    own = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("message", F.row_number().over(own).cast("long"))
    pieces = F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{delta}}}"), F.lit(0))
    event = lambda kind, role, text: F.struct(F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"))
    none, start = F.lit(None).cast("string"), F.substring("text", 1, delta)
    draft = F.array(event("message", F.col("role"), F.lit("")), event("delta", none, start), event("regenerate", none, none))
    streamed = F.concat(draft, F.transform(pieces, lambda x: event("delta", none, x)))
    sent = F.array(event("message", F.col("role"), start))
    whole = F.when(F.length("text") > delta, F.concat(sent, F.array(event("edit", none, F.col("text"))))).otherwise(sent)
    events = F.when(F.col("role") == "assistant", streamed).otherwise(whole)
    rows = rows.select("conv_id", "message", F.posexplode(events).alias("__k", "__event"))
    return rows.select("conv_id", (F.col("message") * (1 << 31) + F.col("__k")).alias("seq"), "message", "__event.*")


def format_chat(log: DataFrame) -> DataFrame:
    """A log's conversations, folded and rendered: (conv_id, formatted, turn_spans); see ``reconstruct`` and ``render``."""
    return render(reconstruct(log))
