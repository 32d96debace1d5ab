"""Splitting oversized items at natural boundaries.

One bounded-quantifier regular expression cuts the text: its alternatives are
ordered by the strength of the boundary they end at, each consumes up to the
limit, and the last takes characters where no boundary helps. The overlap with
the piece before is found by looking back from each cut over the offsets of the
sentence ends. All of it is SQL array functions; no row leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.binding import let

#: Defaults for null options and the ranges they are held within.
TARGET, TARGET_RANGE = 1600, (128, 65536)
MAXIMUM, MAXIMUM_TOP = 2400, 98304
OVERLAP, OVERLAP_RANGE = 1, (0, 32)
#: White space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0" + "".join(map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Where a cut may fall, strongest first; each is looked for behind the cut.
BOUNDARIES = (
    ("paragraph", r"(?<=\n\n)"),
    ("line", r"(?<=\n)"),
    ("sentence", r"(?<=[.!?…][\"'”’»)\]]{0,2}\s|[。！？])"),
    ("clause", r"(?<=[;:,]\s|[、，；：])"),
)
_SENTENCES = r"(?s).+?(?:\n+|[.!?…][\"'”’»)\]]{0,2}\s+|[。！？]+|\z)"


def limits(options: DataFrame) -> DataFrame:
    """``option_id, limit, overlap_units`` within their ranges; a null target is 1600, a null maximum 2400, a null overlap 1."""
    hold = lambda c, lo, hi: F.least(F.greatest(c, F.lit(lo)), F.lit(hi))
    target = hold(F.coalesce("target_characters", F.lit(TARGET)), *TARGET_RANGE)
    top = F.coalesce("max_characters", F.lit(MAXIMUM))
    return options.groupBy("option_id").agg(
        F.max(F.least(F.greatest(top, target), F.lit(MAXIMUM_TOP))).alias("limit"),
        F.max(hold(F.coalesce("overlap_units", F.lit(OVERLAP)), *OVERLAP_RANGE)).alias("overlap_units"),
    )


def cut_pattern(size: Column) -> Column:
    """The expression that cuts pieces of at most ``size`` code points; a strong boundary must lie in the second half."""
    n, half = size.cast("string"), F.floor(size / 2).cast("string")
    strong = [x for _, look in BOUNDARIES for x in (F.lit("|.{"), half, F.lit(","), n, F.lit("}" + look))]
    return F.concat(F.lit(r"(?s).{1,"), n, F.lit(r"}\z"), *strong, F.lit("|.{1,"), n, F.lit(r"}(?<=\s)|.{1,"), n, F.lit(r"}(?!\p{M})|.{1,"), n, F.lit("}"))


def running(lengths: Column, block: int = 64) -> Column:
    """Running sums of an array, in blocks, so that a long one isn't copied once for each of its elements."""
    none = F.array().cast("array<int>")

    def sums(x: Column) -> Column:
        return F.aggregate(x, none, lambda acc, n: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + n)))

    def of(n: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(n) - 1) / block).cast("int")), lambda b: sums(F.slice(n, b * block + 1, block)))

        def shifted(own: Column) -> Column:
            before = sums(F.transform(own, lambda x: F.element_at(x, F.lit(-1))))
            return let(before, lambda at: F.flatten(F.transform(own, lambda x, i: F.when(i == 0, x).otherwise(F.transform(x, lambda y: y + F.get(at, i - 1))))))

        return F.when(F.size(n) > 0, let(blocks, shifted)).otherwise(none)

    return let(lengths, of)


def split_items(items: DataFrame, text: str = "text", limit: str = "limit", overlap_units: str = "overlap_units") -> DataFrame:
    """Adds ``pieces``: an array of ``(piece_no, start, core_length, overlap_length, piece_text)``.

    Texts lose the white space at both ends. A text within the limit is one piece.
    Beyond it, the cores of the pieces follow each other without gap or repetition,
    and each piece but the first starts with an overlap of up to ``overlap_units``
    sentences of what precedes it, at most a quarter of the limit; where not even one
    sentence fits, the overlap starts after a white space or else is that quarter.
    No piece exceeds the limit. Null and blank texts have no pieces.
    """
    room = F.when(F.col(overlap_units) > 0, F.floor(F.col(limit) / 4)).otherwise(0).cast("int")

    def piece(t: Column, cores: Column, stop: Column, core: Column, i: Column) -> Column:
        start = F.when(i == 0, F.lit(0)).otherwise(F.get(stop, i - 1))
        before = F.get(cores, i - 1)
        # what precedes the cut: nearly always the end of the core before; only after a very short core it is sought in the text
        back = F.when(F.char_length(before) >= room, F.right(before, room)).otherwise(F.substring(t, F.greatest(start - room, F.lit(0)) + 1, F.least(room, start)))

        def over(b: Column) -> Column:
            known = (start <= room).cast("int")  # the window begins where the text does, and so does a sentence
            found = F.regexp_extract_all(b, F.lit(_SENTENCES), F.lit(0))

            def of(parts: Column) -> Column:
                # the first part of a window inside the text may have lost its beginning
                whole = F.slice(parts, 2 - known, F.greatest(F.size(parts) - 1 + known, F.lit(0)))
                last = let(F.size(whole), lambda n: F.slice(whole, F.greatest(n - F.col(overlap_units), F.lit(0)) + 1, F.col(overlap_units)))
                tail = F.coalesce(F.nullif(F.char_length(F.regexp_replace(b, r"^\S*\s+(?=\S)", "")), F.lit(0)), F.char_length(b))
                return F.when(F.size(whole) > 0, F.char_length(F.array_join(last, ""))).otherwise(tail)

            return let(found, of)

        def built(b: Column) -> Column:
            n = F.when((i == 0) | (room == 0), F.lit(0)).otherwise(let(b, over))
            return let(
                n,
                lambda n: F.struct(
                    (i + 1).cast("int").alias("piece_no"),
                    start.cast("int").alias("start"),
                    F.char_length(core).alias("core_length"),
                    n.cast("int").alias("overlap_length"),
                    F.when(n == 0, core).otherwise(F.concat(F.right(b, n), core)).alias("piece_text"),
                ),
            )

        return let(back, built)

    def whole(t: Column) -> Column:
        return F.array(F.struct(F.lit(1).alias("piece_no"), F.lit(0).alias("start"), F.char_length(t).alias("core_length"), F.lit(0).alias("overlap_length"), t.alias("piece_text")))

    def cut(t: Column) -> Column:
        cores = F.regexp_extract_all(t, cut_pattern(F.col(limit) - room), F.lit(0))
        return let(cores, lambda c: let(running(F.transform(c, F.char_length)), lambda e: F.transform(c, lambda core, i: piece(t, c, e, core, i))))

    def of(t: Column) -> Column:
        return F.when(F.char_length(t) > F.col(limit), cut(t)).when(F.char_length(t) > 0, whole(t)).otherwise(F.slice(whole(t), 1, 0))

    return items.withColumn("pieces", let(F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(WHITE)), of))


def with_limits(units: DataFrame, files: DataFrame, options: DataFrame) -> DataFrame:
    """``unit_id, unit_text, limit, overlap_units``: units under their file's option, the defaults where it has none.

    Repeated rows of files count once. The options are a table of fixed size and are
    broadcast; the units meet the files on ``file_id``.
    """
    opt = limits(options)
    own = files.groupBy(F.col("id").alias("file_id")).agg(F.max("option_id").alias("option_id")).join(F.broadcast(opt), "option_id", "left").drop("option_id")
    u = units.select(F.col("id").alias("unit_id"), "file_id", "unit_text")
    return u.join(own, "file_id", "left").select("unit_id", "unit_text", F.coalesce("limit", F.lit(MAXIMUM)).alias("limit"), F.coalesce("overlap_units", F.lit(OVERLAP)).alias("overlap_units"))
