"""Response stream assembly in batch: T1-T5 twins, A5, A9, W3, Q4.

Chunks are raw bytes cut anywhere (inside characters too). Lines are
found on the byte ``0x0A``, which never occurs inside a UTF-8 sequence, so
pieces are handled as ISO-8859-1 text (one char per byte, lossless) and
each finished line is decoded as UTF-8 once, with invalid bytes replaced.

A response of any length spreads over many tasks: its chunks are taken in
segments of ``SEGMENT`` consecutive numbers. Inside a segment a running count
of newlines numbers the lines; what goes on from one segment to the next is
one unfinished line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlake.functions.stream import delta_of, kind_of, line_variant, with_line_parse
from reviewlake.functions.text import estimate_tokens

CHUNK_COLUMNS = ["request_id", "seq", "service", "payload", "is_last"]
SEGMENT = 4096


def _segmented(chunks: DataFrame, segment: int) -> DataFrame:
    """Chunks split on newline bytes, with their segment and the newlines before them in it.

    A chunk that was delivered again (same response and ``seq``) counts once; one without
    payload adds no text.
    """
    parts = F.coalesce(F.split(F.decode(F.col("payload"), "ISO-8859-1"), "\n", -1), F.array(F.lit("")))
    c = chunks.select("request_id", "service", "seq", "is_last", F.octet_length("payload").alias("_bytes"),
                      parts.alias("_parts"), F.floor(F.col("seq") / F.lit(segment)).cast("long").alias("_seg"))
    c = c.withColumn("_nl", F.size("_parts") - 1)
    order = Window.partitionBy("request_id", "_seg").orderBy("seq")
    w = order.rowsBetween(Window.unboundedPreceding, -1)
    # both windows share one exchange and one sort
    c = c.withColumn("_prev", F.lag("seq").over(order)).where(
        F.col("_prev").isNull() | (F.col("_prev") != F.col("seq"))).drop("_prev")
    return c.withColumn("_before", F.coalesce(F.sum("_nl").over(w), F.lit(0)))


def _pieces(c: DataFrame) -> DataFrame:
    """One row per piece of a chunk: the number of its line, and whether a newline ends it."""
    p = c.select("request_id", "service", "seq", "_seg", "_before", "_nl", "_bytes", "is_last",
                 F.posexplode("_parts").alias("_k", "_piece"))
    return p.withColumn("line_no", (F.col("_before") + F.col("_k")).cast("bigint")) \
            .withColumn("_term", F.col("_k") < F.col("_nl"))


def _in_order() -> Column:
    return F.array_sort(F.collect_list(F.struct("seq", "_piece")))


def _joined(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda x: x["_piece"]), "")


def _utf8(latin: Column) -> Column:
    return F.make_valid_utf8(F.encode(latin, "ISO-8859-1").cast("string"))


def assemble_lines(chunks: DataFrame, flush_tail: bool = False, segment: int = SEGMENT) -> DataFrame:
    """T1 batch twin: complete lines per response, numbered in order.

    The newlines of the segments before come from a summary of one row per segment. A trailing
    piece without a newline is dropped unless ``flush_tail``. Output: request_id, service, line_no, line.
    """
    c = _segmented(chunks, segment)
    totals = c.groupBy("request_id", "_seg").agg(F.sum("_nl").alias("_in"))
    ahead = Window.partitionBy("request_id").orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    offset = totals.withColumn("_offset", F.coalesce(F.sum("_in").over(ahead), F.lit(0))).drop("_in")
    c = c.join(offset, ["request_id", "_seg"]).withColumn("_before", F.col("_before") + F.col("_offset"))
    lines = _pieces(c).groupBy("request_id", "line_no").agg(
        F.first("service").alias("service"), _in_order().alias("_ps"), F.max("_term").alias("_complete"))
    if not flush_tail:
        lines = lines.where(F.col("_complete"))
    return lines.select("request_id", "service", "line_no", _utf8(_joined(F.col("_ps"))).alias("line"))


def classify_lines(lines: DataFrame) -> DataFrame:
    """T2 + T3: tag each line ``skip`` / ``malformed`` / ``data`` and extract its delta."""
    return with_line_parse(lines)


def extract_deltas(lines: DataFrame) -> DataFrame:
    """Non-empty deltas in order: request_id, line_no, content."""
    return (classify_lines(lines).where((F.col("kind") == "data") & (F.col("content") != ""))
            .select("request_id", "line_no", "content"))


def route_malformed(lines: DataFrame) -> DataFrame:
    """Lines that failed to parse (dead letters); the stream goes on."""
    return classify_lines(lines).where(F.col("kind") == "malformed").select(
        "request_id", "line_no", "line")


def agg_stream_content(deltas: DataFrame) -> DataFrame:
    """A5 / T5 twin: deltas concatenated in order per response."""
    return (deltas.groupBy("request_id")
            .agg(F.array_sort(F.collect_list(F.struct("line_no", "content"))).alias("_d"),
                 F.count(F.lit(1)).alias("n_deltas"))
            .select("request_id", F.array_join(F.transform("_d", lambda x: x["content"]), "")
                    .alias("content"), "n_deltas"))


def _status(c: DataFrame) -> DataFrame:
    return (c.groupBy("request_id")
            .agg(F.first("service").alias("service"),
                 F.count(F.lit(1)).alias("chunk_count"),
                 F.sum("_bytes").cast("bigint").alias("total_bytes"),
                 F.max("_bytes").cast("bigint").alias("max_chunk_bytes"),
                 F.max("seq").alias("_max_seq"),
                 F.max(F.col("is_last").cast("int")).alias("_last"))
            .withColumn("ended", (F.col("_last") == 1)
                        & (F.col("chunk_count") == F.col("_max_seq") + 1))
            .drop("_max_seq", "_last"))


def stream_status(chunks: DataFrame) -> DataFrame:
    """T4 twin + A9: ended flag (last chunk seen, no gap) and chunk statistics.

    A chunk that was delivered again counts once, as in ``assemble_responses``.
    """
    c = chunks.select("request_id", "service", "seq", "is_last", F.octet_length("payload").alias("_bytes"))
    return _status(c.dropDuplicates(["request_id", "seq"]))


def _segment_rows(chunks: DataFrame, segment: int) -> DataFrame:
    """One row per segment: its deltas, chunk statistics, and the unfinished lines at both ends.

    The lines of a segment are put together and parsed where its chunks are. ``_head`` is the line
    that the segment before may have begun (none in a first segment), ``_tail`` the one it leaves open.
    """
    own = F.col("_k") == 0
    g = _pieces(_segmented(chunks, segment)).groupBy("request_id", "_seg", "line_no").agg(
        F.first("service").alias("service"), _in_order().alias("_ps"), F.max("_term").alias("_complete"),
        F.count_if(own).alias("_c"), F.sum(F.when(own, F.col("_bytes"))).alias("_sb"),
        F.max(F.when(own, F.col("_bytes"))).alias("_mb"), F.max(F.when(own, F.col("seq"))).alias("_ms"),
        F.max(F.when(own, F.col("is_last").cast("int"))).alias("_l"))
    g = g.withColumn("_latin", _joined(F.col("_ps"))).drop("_ps")
    inner = F.col("_complete") & ((F.col("line_no") > 0) | (F.col("_seg") == 0))
    g = with_line_parse(g.withColumn("line", F.when(inner, _utf8(F.col("_latin")))))
    cut = (F.col("line_no") == 0) & (F.col("_seg") > 0)
    return g.groupBy("request_id", "_seg").agg(
        F.first("service").alias("service"),
        F.array_sort(F.collect_list(F.when((F.col("kind") == "data") & (F.col("content") != ""),
                                           F.struct("line_no", "content")))).alias("_d"),
        F.count_if(F.col("kind") == "malformed").alias("_bad"),
        F.max(F.when(cut, F.struct(F.col("_latin").alias("text"), F.col("_complete").alias("ends")))).alias("_head"),
        F.max(F.when(~cut & ~F.col("_complete"), F.col("_latin"))).alias("_tail"),
        F.sum("_c").alias("_c"), F.sum("_sb").alias("_sb"), F.max("_mb").alias("_mb"), F.max("_ms").alias("_ms"),
        F.max("_l").alias("_l"))


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _stitched(segments: str, service: str, flush_tail: bool) -> Column:
    """The segments of a response in order -> struct(text, deltas, bad, carry).

    A line that crosses segments is decoded and parsed here, once it ends.
    """
    def with_line(text, deltas, bad, latin, more, n, b):
        def parsed(v, line):
            kind = kind_of(service, line, v)
            return F.struct((kind == "malformed").alias("bad"), F.when(kind == "data", delta_of(service, v)).otherwise(F.lit("")).alias("delta"))

        def added(r):
            return F.struct(F.concat(text, r["delta"], more).alias("text"), (deltas + n + F.when(r["delta"] != "", 1).otherwise(0)).cast("long").alias("deltas"),
                            (bad + b + F.when(r["bad"], 1).otherwise(0)).cast("long").alias("bad"))

        return _let(_utf8(latin), lambda line: _let(_let(line_variant(service, line), lambda v: parsed(v, line)), added))

    def state(parts: Column, carry: Column) -> Column:
        return F.struct(parts["text"].alias("text"), parts["deltas"].alias("deltas"), parts["bad"].alias("bad"), carry.alias("carry"))

    def step(acc, s):
        tail = F.coalesce(s["_tail"], F.lit(""))
        plain = F.struct(F.concat(acc["text"], s["text"]).alias("text"), (acc["deltas"] + s["n"]).alias("deltas"), (acc["bad"] + s["_bad"]).alias("bad"))
        held = F.struct(acc["text"].alias("text"), acc["deltas"].alias("deltas"), acc["bad"].alias("bad"))
        joined = F.concat(acc["carry"], s["_head"]["text"])
        return (F.when(s["_head"].isNull(), state(plain, tail))
                .when(~s["_head"]["ends"], state(held, joined))
                .otherwise(state(with_line(acc["text"], acc["deltas"], acc["bad"], joined, s["text"], s["n"], s["_bad"]), tail)))

    zero = F.lit(0).cast("long")
    start = F.struct(F.lit("").alias("text"), zero.alias("deltas"), zero.alias("bad"), F.lit("").alias("carry"))

    def finish(acc):
        if not flush_tail:
            return acc
        return F.when(acc["carry"] == "", acc).otherwise(
            state(with_line(acc["text"], acc["deltas"], acc["bad"], acc["carry"], F.lit(""), zero, zero), F.lit("")))

    return F.aggregate(segments, start, step, finish)


def assemble_responses(chunks: DataFrame, flush_tail: bool = False, segment: int = SEGMENT) -> DataFrame:
    """Q4 batch twin: final content per response with token estimate and status.

    Chunks are exchanged once, on (request_id, segment): numbering, line groups, parsing and the
    segment's deltas reuse that partitioning, and chunk statistics ride along. What goes on to the
    response is one row per segment with the text it adds to the content.
    """
    rows = _segment_rows(chunks, segment).select(
        "request_id", "service", "_c", "_sb", "_mb", "_ms", "_l",
        F.struct("_seg", F.array_join(F.transform("_d", lambda x: x["content"]), "").alias("text"),
                 F.size("_d").cast("long").alias("n"), "_bad", "_head", "_tail").alias("_s"))
    per_req = rows.groupBy("request_id").agg(
        F.first("service").alias("service"), F.array_sort(F.collect_list("_s")).alias("_segments"),
        F.sum("_c").alias("chunk_count"), F.sum("_sb").cast("bigint").alias("total_bytes"),
        F.max("_mb").cast("bigint").alias("max_chunk_bytes"), F.max("_ms").alias("_max_seq"), F.max("_l").alias("_last"))
    done = per_req.withColumn("_r", _stitched("_segments", "service", flush_tail))
    content = F.col("_r.text")
    return done.select(
        "request_id", "service", content.alias("content"), estimate_tokens(content).alias("tokens"),
        F.col("_r.deltas").alias("n_deltas"), F.col("_r.bad").alias("n_malformed"),
        ((F.col("_last") == 1) & (F.col("chunk_count") == F.col("_max_seq") + 1)).alias("ended"),
        F.col("chunk_count").cast("bigint").alias("chunk_count"), "total_bytes", "max_chunk_bytes")


def running_content(deltas: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """Text shown after each delta (all deltas so far), or after those of ``frames`` (request_id, line_no) only.

    Each frame is a prefix of the response's text, cut at the running length of its deltas, so
    no frame is put together from pieces; all frames of a response are quadratic in its length by
    definition, which ``frames`` avoids.
    """
    w = (Window.partitionBy("request_id").orderBy("line_no")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    at = deltas.select("request_id", "line_no", "content", F.sum(F.char_length("content")).over(w).alias("_upto"))
    if frames is not None:
        at = at.join(frames.select("request_id", "line_no").distinct(), ["request_id", "line_no"], "left_semi")
    whole = agg_stream_content(deltas).select("request_id", F.col("content").alias("_text"))
    return at.join(whole, "request_id").select(
        "request_id", "line_no", "content", F.substring("_text", F.lit(1), F.col("_upto").cast("int")).alias("shown"))
