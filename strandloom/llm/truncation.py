"""Problem 8: texts cut off by field limits or broken transfers.

For each source the hazard of a length is the share of the texts at least that long that
end exactly there.  It is computed by windows over the counts of lengths, in characters and in
UTF-8 bytes, and tested against the hazard of the neighbouring lengths; Benjamini and
Hochberg's procedure controls the false discoveries.  At a significant length every ending
that isn't closed is a cut, also one with a mark of shortening.

Elsewhere the corpus tells by its own hazards what a whole ending is.  A line, or a line's words before its last, closes texts
(as titles, credits and adverts do) if texts end behind it far oftener than behind other lines that end a cue, by the same
control of false discoveries; a beginning of a commoner closing line is none, since of the texts that get so far few stop there.
A word is whole by the share of its uses at a cue's end, all cues but the last of each text, which no cut can have touched,
that are whole.  Shares don't grow with the corpus, and equal texts count once, so copies of a corpus flag the same texts.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..session import hinted, written

#: Lengths on either side that are compared with one length; false-discovery rate.
NEIGHBOURS, RATE = 16, 1e-4
#: A word or line is a whole ending if the share of its uses at a cue's end that are whole is at least SHARE, with 95 percent confidence.
SHARE, CONFIDENCE = 0.5, 1.645
#: A line closes texts if at least this share of its uses do, and this share of the texts that get as far as it stop there.
CLOSING, STOPS = 0.1, 0.5
#: Beginnings of up to so many characters are written out; longer ones are found among sorted lines. It changes no result.
LONGEST_LINE = 200
#: A sentence's mark at a line's end; a next cue that goes on with a sentence; one in a script that doesn't tell.
_MARKED = r"(?<!\.)[.!?。！？؟．](?:</?[A-Za-z][^<>]*>|[\s\"'”’»›)\]）」』♪])*$"
_AHEAD = r"^(?:</?[A-Za-z][^<>]*>|\{[^{}]*\}|[^\p{L}\p{N}<{])*"


#: What may follow the last visible character: blanks, line ends and byte-order marks.
BLANKS = " \t\r\n\f\v\u00a0\u3000\ufeff\u200b"


def _last_line(text: Column) -> Column:
    """The last line that shows anything; found from the end, so that a text is not gone through."""
    near = F.rtrim(F.substring_index(text, "\n", -6), F.lit(BLANKS))
    shown = F.when(near != "", near).otherwise(F.rtrim(text, F.lit(BLANKS)))
    return F.substring_index(F.substring_index(shown, "\n", -1), "\r", -1)


def _plain(line: Column) -> Column:
    """A line without tags and without quotes, brackets and notes around its end."""
    return F.regexp_replace(F.regexp_replace(line, r"</?[A-Za-z][^<>]*>|\{[^{}]*\}", ""), "[\\s\"'”’»›)\\]）」』♪]+$", "")


def _end_word(line: Column) -> Column:
    """What a line ends with: its last word in lower case without marks, digits as 0; of scripts without spaces the last two characters."""
    word = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_extract(line, r"(\S+)\s*$", 1), r"[^\p{L}\p{N}$]", ""), r"\p{N}+", "0"))
    return F.when(word.rlike(r"[぀-ヿ㐀-鿿]"), F.right(word, F.lit(2))).otherwise(word)


def _line_key(line: Column) -> Column:
    return F.regexp_replace(F.trim(line), r"\p{N}+", "0")


def _spaced(key: Column) -> Column:
    """A line with one blank between its words."""
    return F.array_join(F.split(key, r"\s+"), " ")


def _heads(key: Column) -> Column:
    """All beginnings of a line of whole words, up to LONGEST_LINE characters and but for the line itself, each with the word that follows."""
    words = F.split(key, r"\s+")
    # Behind each of the words that begin within so many characters, but the last of them, a beginning ends there.
    lead = F.size(F.split(F.left(_spaced(key), F.lit(LONGEST_LINE + 1)), " "))
    words = F.when(F.length(key) <= LONGEST_LINE, words).otherwise(F.slice(words, F.lit(1), lead))
    each = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.struct(F.array_join(F.slice(w, F.lit(1), i), " ").alias("head"), F.get(w, i).alias("next")))
    # The words are an argument, so that they are split once and not for each beginning.
    return F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 1, each(w)).otherwise(F.array().cast("array<struct<head:string,next:string>>"))), F.lit(0))


def _common(a: bytes, b: bytes) -> int:
    """The number of bytes that both begin with."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _inner(words: bool):
    """Folds sorted lines (text, opened, ended, uses) into the beginnings that several of them share: (key, own, opened, ended, uses, top).

    ``own`` counts the open texts of the line that is the beginning itself, the others count the longer lines, ``top`` the most open texts of one continuation.
    With ``words`` texts end with a blank and beginnings are of whole words, without their last blank; otherwise they are lines themselves.
    The beginnings of one line are held, as lengths, and nothing else.
    """

    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        last, stack = b"", [[0, 0, 0, 0, 0, 0, 0, 0]]  # length, own (opened, ended, uses), below it (opened, ended, uses), top

        def close(upto: int) -> Iterator[tuple]:
            while stack[-1][0] > upto:
                length, *own, opened, ended, uses, top = stack.pop()
                if opened and (words or own[0]):
                    yield last[: length - words], own[0], opened, ended, uses, top
                if stack[-1][0] < upto:
                    stack.append([upto, 0, 0, 0, 0, 0, 0, 0])
                above = stack[-1]
                for k, more in enumerate((own[0] + opened, own[1] + ended, own[2] + uses)):
                    above[4 + k] += more
                above[7] = max(above[7], own[0] + opened)

        for text, *counts in rows:
            text = bytes(text)
            shared = _common(last, text)
            yield from close(last.rfind(b" ", 0, shared) + 1 if words else shared)
            if stack[-1][0] < len(text):
                stack.append([len(text), 0, 0, 0, 0, 0, 0, 0])
            for k, more in enumerate(counts):
                stack[-1][1 + k] += more
            last = text
        yield from close(0)

    return fold


def _under(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Folds sorted lines and heads (text, is_head), all with a blank at the end, into the lines that go on behind a head."""
    head = None
    for text, is_head in rows:
        text = bytes(text)
        if head is not None and text.startswith(head):
            if not is_head and len(text) > len(head):
                yield (text[:-1],)
        elif is_head:
            head = text


def _folded(rows: DataFrame, fold, schema: str) -> DataFrame:
    """The rows (text, ...) in the order of their texts' bytes, those with equal first LONGEST_LINE + 1 characters in one task; as rows of Python, which come a few at a time however long they are."""
    near = rows.repartition(F.xxhash64(F.left("text", F.lit(LONGEST_LINE + 1)))).sortWithinPartitions("text")
    out = rows.sparkSession.createDataFrame(near.withColumn("text", F.col("text").cast("binary")).rdd.mapPartitions(fold), schema, verifySchema=False)
    return out.withColumn("key", F.col("key").cast("string"))


def _discovered(tests: DataFrame, family: list[str], order: list[str], rate: float, size: str | None = None) -> DataFrame:
    """The tests whose ``p`` Benjamini and Hochberg's procedure rejects within each family; ``size`` names the number of its tests if not all are rows."""
    by = W.partitionBy(*family)
    h = tests.withColumn("_tests", F.col(size) if size else F.count(F.lit(1)).over(by))
    # Only p <= rate can be rejected, so only those are ranked.
    few = h.where(F.col("p") <= rate).withColumn("_rank", F.row_number().over(by.orderBy("p", *order)))
    passed = F.when(F.col("p") <= F.col("_rank") * rate / F.col("_tests"), F.col("_rank"))
    return few.withColumn("_upto", F.max(passed).over(by)).where(F.col("_rank") <= F.col("_upto")).drop("_rank", "_upto", "_tests")


def _tail(k: Column, mu: Column) -> Column:
    """Bounds the chance of k or more where mu are expected (Chernoff's bound of a Poisson tail)."""
    return F.when(k > mu, F.exp(-(k * F.log(k / mu) - k + mu))).otherwise(1.0)


def length_hazards(documents: DataFrame, neighbours: int = NEIGHBOURS) -> DataFrame:
    """(source, unit, length, texts, at_risk, hazard, expected, p) of every length that occurs.

    ``unit`` is chars or bytes.  ``expected`` is the number of texts that would end at a length with the hazard of its neighbours;
    ``p`` bounds the chance of so many or more (Chernoff's bound of a Poisson tail).  Null, empty and blank texts are left out, a null source is one of its own.
    Equal texts of a source count once: copies of a text are no evidence of a limit.
    """
    d = documents.where(_last_line(F.col("text")) != "").select(F.coalesce("source", F.lit("")).alias("source"), F.struct(F.lit("chars").alias("unit"), F.length("text").cast("long").alias("length")).alias("_c"), F.struct(F.lit("bytes").alias("unit"), F.octet_length("text").cast("long").alias("length")).alias("_b"), F.xxhash64("text").alias("_h"))
    d = d.dropDuplicates(["source", "_c", "_b", "_h"]).select("source", F.explode(F.array("_c", "_b")).alias("_x")).select("source", "_x.*")
    counts = d.groupBy("source", "unit", "length").agg(F.count(F.lit(1)).alias("texts"))
    by = W.partitionBy("source", "unit").orderBy("length")
    after = W.partitionBy("source", "unit").orderBy(F.col("length").desc()).rowsBetween(W.unboundedPreceding, 0)
    near = by.rangeBetween(-neighbours, neighbours)
    h = counts.withColumn("at_risk", F.sum("texts").over(after)).withColumn("hazard", F.col("texts") / F.col("at_risk"))
    # The neighbours' hazard: texts that end near by for each text at risk there, one end added. The three largest counts are left
    # out, since the length itself and further limits near by must not hide it; lengths that don't occur count as at risk.
    others = F.array_sort(F.collect_list("texts").over(near))
    ended = F.aggregate(F.slice(others, 1, F.greatest(F.size(others) - 3, F.lit(0))), F.lit(0).cast("long"), lambda a, x: a + x)
    beside = (ended + 1) / (F.avg("at_risk").over(near) * (2 * neighbours - 2))
    h = h.withColumn("expected", F.col("at_risk") * beside)
    return h.withColumn("p", _tail(F.col("texts").cast("double"), F.col("expected")))


def field_limits(documents: DataFrame, rate: float = RATE, neighbours: int = NEIGHBOURS) -> DataFrame:
    """(source, unit, length, texts, at_risk, hazard, expected, p) of the lengths whose hazard is significantly high."""
    # The lengths of one source and unit are one family of tests.
    return _discovered(length_hazards(documents, neighbours), ["source", "unit"], ["length"], rate)


def cue_ends(documents: DataFrame) -> DataFrame:
    """How cues end: (kind, key, uses, whole), counted over all cues but the last of each text, and all lines but the last of texts without cue times.

    ``kind`` is word for the last word of each; line for the last line of those that end with a letter or a digit.  ``whole`` counts the uses
    that end with a sentence's mark or that the next cue doesn't go on with (in lower case, or in the same script if that has no cases).
    Equal lines before equal cues are one use.
    """
    parts = F.split("text", F.when(F.col("text").contains("-->"), r"\r?\n[ \t]*\r?\n").otherwise(r"\r?\n"), -1)
    cues = documents.select(parts.alias("_p")).where(F.size("_p") > 1)
    heads = F.transform(F.slice("_p", F.lit(2), F.size("_p") - 1), lambda x: F.left(x, F.lit(120)))
    cues = cues.select(F.explode(F.arrays_zip(F.slice("_p", F.lit(1), F.size("_p") - 1).alias("cue"), heads.alias("head"))).alias("_x"))
    head = F.regexp_replace(F.col("_x.head"), r"^[^>]*-->[^\n]*(\n|$)", "")
    cues = cues.select(_last_line(F.col("_x.cue")).alias("_line"), head.alias("_head")).where(F.col("_line") != "")
    bare = F.right("_line", F.lit(1)).rlike(r"[\p{L}\p{N}]")
    caseless = F.right("_line", F.lit(2)).rlike(r"\p{Lo}") & F.col("_head").rlike(_AHEAD + r"\p{Lo}")
    whole = F.right("_line", F.lit(24)).rlike(_MARKED) | ~(F.col("_head").rlike(_AHEAD + r"\p{Ll}") | caseless)
    cues = cues.select(F.xxhash64("_line", "_head").alias("_h"), F.substring_index("_line", " ", 1).alias("_first"), F.substring_index("_line", " ", -1).alias("_word"), F.when(bare, F.col("_line")).alias("_bare"), whole.cast("long").alias("_whole"))
    cues = cues.distinct()  # all follows from _h; without a first value of anything the rows needn't be sorted
    # Raw words and lines are counted first; only the distinct ones are normalised.
    word, line = F.struct(F.lit("word").alias("kind"), F.col("_word").alias("key")), F.when(F.col("_bare").isNotNull(), F.struct(F.lit("line").alias("kind"), F.col("_bare").alias("key")))
    first = F.struct(F.lit("first").alias("kind"), F.col("_first").alias("key"))
    raw = cues.select("_whole", F.explode(F.array_compact(F.array(word, line, first))).alias("_x")).groupBy("_x.kind", "_x.key").agg(F.count(F.lit(1)).alias("uses"), F.sum("_whole").alias("whole"))
    key = F.when(F.col("kind") == "word", _end_word(_plain(F.col("key")))).otherwise(_line_key(F.col("key")))
    return raw.groupBy("kind", key.alias("key")).agg(F.sum("uses").alias("uses"), F.sum("whole").alias("whole")).where(F.col("key") != "")


def _at_least(hits: Column, n: Column, z: float = CONFIDENCE) -> Column:
    """The lower bound of a share (Wilson's)."""
    p = hits / n
    return (p + z * z / 2 / n - z * F.sqrt(p * (1 - p) / n + z * z / 4 / n / n)) / (1 + z * z / n)


def endings(documents: DataFrame) -> DataFrame:
    """(doc_id, source, ending, address, _word, _line, chars, bytes, _h): how each text that isn't blank ends.

    ``ending``: place (in a cue's number, times or tag), closed, short (three dots), open.  The last six lines are looked at first; where none shows anything, all are.
    """
    bare = F.trim("text").rlike(r"^[\s\uFEFF]*(WEBVTT\s+)?[\dOolI]+\s*$")
    d = documents.select("doc_id", "source", F.length("text").cast("long").alias("chars"), F.octet_length("text").cast("long").alias("bytes"), F.col("text").contains("-->").alias("_timed"), bare.alias("_alone"), _last_line(F.col("text")).alias("_last"), F.xxhash64("text").alias("_h"))
    d = d.where(F.col("_last") != "").withColumn("_plain", _plain(F.col("_last")))
    # A number alone is a cue's; of texts without times only where nothing stands before it.
    number = F.col("_last").rlike(r"^\s*[\dOolI]+\s*$") & (F.col("_timed") | F.col("_alone"))
    times = F.col("_last").rlike(r"^\s*[\dOolI]{1,3}:[\dOolI:,. ]*(-{1,2}>?[\dOolI:,. ]*)?$") | F.col("_last").rlike(r"^[\dOolI:,. ]+-->.*$")
    tag = F.col("_last").rlike(r"(</?[A-Za-z]*|\{[^{}]*)$") | (F.trim("_last") == "WEBVTT")
    sound = F.col("_last").rlike(r"[(\[（【][^()\[\]（）【】]*[)\]）】]\W*$")
    song = F.col("_last").rlike(r"[♪♫#].*[♪♫#]\W*$")
    dash = F.col("_plain").rlike(r"[-‐-―ー]$")
    short = F.col("_plain").rlike(r"(\.\.+|…|\[…\]|\[\.\.\.\])$")
    # A point within an address closes nothing.
    address = F.col("_plain").rlike(r"(?i)(www|https?:/*\S*)\.$")
    closed = F.col("_plain").rlike(r"[.!?。！？؟．]$") & ~address
    ending = F.when(number | times | tag, "place").when(sound | song | dash, "closed").when(short, "short").when(closed, "closed").otherwise("open")
    line = _line_key(F.col("_last"))
    return d.select(
        "doc_id", "source", ending.alias("ending"), F.col("_plain").rlike(r"(?i)(://\S*|[a-z0-9]\.[a-z0-9/-]*)$").alias("address"),
        _end_word(_plain(F.col("_last"))).alias("_word"), line.alias("_line"), "chars", "bytes", "_h",
    )


def _long(texts: DataFrame, lined: DataFrame) -> DataFrame:
    """(kind, key, texts, _closed, _said) of the lines, and heads of lines, of more than LONGEST_LINE characters that may close texts; ``_said`` is their uses.

    Only lines that share their first characters with another one are sorted, others have nothing longer behind them and no heads that several words follow.
    """
    opened = F.count_if(F.col("ending") == "open").alias("opened")
    lines = written(texts.where(F.length("_line") > LONGEST_LINE).groupBy(F.col("_line").alias("key")).agg(opened, F.count(F.lit(1)).alias("ended")), "long-lines")
    said = lined.where(F.length("key") > LONGEST_LINE).select("key", F.lit(0).cast("long").alias("opened"), F.lit(0).cast("long").alias("ended"), "uses")

    def beginnings(rows: DataFrame, words: bool) -> DataFrame:
        text = F.concat(_spaced(F.col("key")), F.lit(" ")) if words else F.col("key")
        rows = rows.withColumn("text", text).withColumn("_g", F.xxhash64(F.left("text", F.lit(LONGEST_LINE + 1))))
        shared = hinted(rows.where(F.col("opened") > 0).groupBy("_g").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select("_g"))
        rows = rows.join(shared, "_g", "left_semi").select("text", "opened", "ended", "uses")
        return _folded(rows, _inner(words), "key binary, own long, opened long, ended long, uses long, top long").where(F.length("key") > LONGEST_LINE)

    open_lines = lines.where(F.col("opened") > 0).withColumn("uses", F.lit(0).cast("long"))
    passed = beginnings(open_lines, False).where(F.col("own") < STOPS * (F.col("own") + F.col("opened"))).select("key")
    whole = open_lines.drop("uses").join(passed, "key", "left_anti").join(said.select("key", "uses"), "key", "left")
    whole = whole.select(F.lit("line").alias("kind"), "key", F.col("opened").alias("texts"), F.lit(0).cast("long").alias("_closed"), F.coalesce("uses", F.lit(0)).cast("long").alias("_said"))
    heads = beginnings(lines.withColumn("uses", F.lit(0).cast("long")).unionByName(said), True).where((F.col("opened") >= STOPS * F.col("ended")) & (F.col("top") <= STOPS * F.col("opened")))
    return whole.unionByName(heads.select(F.lit("head").alias("kind"), "key", F.col("opened").alias("texts"), (F.col("ended") - F.col("opened")).alias("_closed"), F.col("uses").alias("_said")))


def closing_lines(ends: DataFrame, uses: DataFrame, rate: float = RATE) -> DataFrame:
    """(kind, key) of the lines, and heads of lines, behind which texts end by themselves.

    Of all uses of a line, or of lines with a head, at a cue's end its hazard is the share behind which the text ends.  It must be significantly
    above the hazard of all cues' ends and at least CLOSING.  Of the texts whose last line begins like a line at least STOPS must stop there;
    a head must end open in at least STOPS of its texts, and be followed by so many words that none of them has more than STOPS.
    """
    texts = ends.select("_h", "ending", "_line").distinct()
    lines = texts.where((F.col("ending") == "open") & (F.length("_line") > 0)).groupBy(F.col("_line").alias("key")).agg(F.count(F.lit(1)).alias("texts"))
    n_texts, longest = texts.agg(F.count(F.lit(1)), F.max(F.length("_line"))).first()
    n_cues = uses.where(F.col("kind") == "word").agg(F.sum("uses")).first()[0] or 0
    usual = n_texts / max(n_texts + n_cues, 1)
    # Texts whose last line begins with a key, however it goes on.
    reach = lines.select("texts", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length("key"), F.lit(LONGEST_LINE))), lambda i: F.left("key", i))).alias("key")).groupBy("key").agg(F.sum("texts").alias("_reach"))
    whole = lines.where(F.length("key") <= LONGEST_LINE).join(reach, "key").where(F.col("texts") >= STOPS * F.col("_reach")).select(F.lit("line").alias("kind"), "key", "texts", F.lit(0).cast("long").alias("_closed"))
    # Heads with what follows them; of the texts whose last line has the head most must end open, and those that don't are further uses of it.
    opened = F.sum((F.col("ending") == "open").cast("long"))
    follow = texts.select("ending", F.explode(_heads(F.col("_line"))).alias("_x")).groupBy("_x.head", "_x.next").agg(opened.alias("_m"), F.count(F.lit(1)).alias("_all"))
    heads = follow.groupBy("head").agg(F.sum("_m").alias("texts"), F.sum("_all").alias("_ended"), F.max("_m").alias("_top")).where((F.col("texts") >= STOPS * F.col("_ended")) & (F.col("_top") <= STOPS * F.col("texts")))
    heads = heads.select(F.lit("head").alias("kind"), F.col("head").alias("key"), "texts", (F.col("_ended") - F.col("texts")).alias("_closed"))
    found, lined = whole.unionByName(heads).withColumn("_said", F.lit(None).cast("long")), uses.where(F.col("kind") == "line")
    if (longest or 0) > LONGEST_LINE:
        found = found.unionByName(_long(texts, lined))
    # Fewer texts than this cannot be significant, however few uses a line has.
    possible = _tail(F.col("texts").cast("double"), F.col("texts") * F.lit(usual)) <= rate
    found = found.withColumn("_family", F.count(F.lit(1)).over(W.partitionBy("kind"))).where(possible)
    found = written(found, "closing")
    few = hinted(found.where(F.col("_said").isNull()).select("kind", "key"))
    mine = lined.select("kind", "key", "uses").unionByName(lined.select(F.lit("head").alias("kind"), F.explode(_heads(F.col("key"))["head"]).alias("key"), "uses"))
    mine = mine.join(few, ["kind", "key"], "left_semi").groupBy("kind", "key").agg(F.sum("uses").alias("uses"))
    c = found.join(mine, ["kind", "key"], "left").withColumn("_n", F.col("texts") + F.col("_closed") + F.coalesce("uses", "_said", F.lit(0)))
    c = c.withColumn("p", _tail(F.col("texts").cast("double"), F.col("_n") * F.lit(usual)))
    c = _discovered(c, ["kind"], ["key"], rate, "_family").where(_at_least(F.col("texts"), F.col("_n")) >= CLOSING)
    # Heads are counted in unclosed lines; closed ones are told by their first word, which is a use of every head that begins so.
    firsts = uses.where(F.col("kind") == "first").select(F.col("key").alias("_first"), F.col("uses").alias("_firsts"))
    c = c.withColumn("_first", F.substring_index("key", " ", 1)).join(firsts, "_first", "left")
    return c.where((F.col("kind") == "line") | (F.col("texts") >= CLOSING * F.coalesce("_firsts", F.lit(0)))).select("kind", "key")


def _by_line(closing: DataFrame, lines: DataFrame) -> DataFrame:
    """The closing lines and heads; instead of heads of more than LONGEST_LINE characters, as heads the lines that go on behind one."""
    long = (F.col("kind") == "head") & (F.length("key") > LONGEST_LINE)
    heads = closing.where(long).select(F.concat("key", F.lit(" ")).alias("text"), F.lit(True).alias("is_head"))
    lines = lines.select(F.concat(_spaced(F.col("_line")), F.lit(" ")).alias("text"), F.lit(False).alias("is_head")).distinct()
    first = F.xxhash64(F.left("text", F.lit(LONGEST_LINE + 1)))
    rows = heads.unionByName(lines.withColumn("_g", first).join(hinted(heads.select(first.alias("_g")).distinct()), "_g", "left_semi").drop("_g"))
    return closing.where(~long).unionByName(_folded(rows, _under, "key binary").select(F.lit("head").alias("kind"), "key"))


def truncated(documents: DataFrame, rate: float = RATE, neighbours: int = NEIGHBOURS) -> DataFrame:
    """(doc_id, source, chars, bytes, limit, unit, at_limit) of the texts that lost their end.

    ``limit`` and ``unit`` name the significant length that a text ends at, null for a transfer broken elsewhere.
    Null, empty and blank texts are no cases; a null source is one of its own; columns other than doc_id, source and text do not matter.
    """
    ends = written(endings(documents), "endings")
    uses = written(cue_ends(documents), "cue-ends")
    e = ends.where(F.col("ending") != "closed")
    # A cut in bytes drops the broken character, and blanks at the end may be lost, so texts just below a limit belong to it.
    limits = written(field_limits(documents, rate, neighbours).select(F.col("source").alias("_s"), F.col("unit").alias("_u"), F.explode(F.sequence(F.col("length") - 3, F.col("length"))).alias("_at"), "length"), "limits")
    near = limits.groupBy("_s", "_u", "_at").agg(F.min("length").alias("length"))
    for unit in ("chars", "bytes"):
        mine = near.where(F.col("_u") == unit).select(F.col("_s").alias(f"_s_{unit}"), F.col("_at").alias(f"_at_{unit}"), F.struct("length", F.lit(unit).alias("unit")).alias(f"_l_{unit}"))
        e = e.join(mine, (F.coalesce("source", F.lit("")) == F.col(f"_s_{unit}")) & (F.col(unit) == F.col(f"_at_{unit}")), "left").drop(f"_s_{unit}", f"_at_{unit}")
    e = e.withColumn("_l", F.least("_l_chars", "_l_bytes"))
    known = uses.where((F.col("kind") != "first") & (_at_least(F.col("whole"), F.col("uses")) >= SHARE)).select("kind", "key", F.lit(True).alias("_known"), F.lit(False).alias("_closes"))
    closing, long = closing_lines(ends, uses, rate), F.length("_line") > LONGEST_LINE
    # A long line asks for its long heads at once: whether it goes on behind one of them is told under its own words.
    has_long = not ends.where((F.col("ending") != "closed") & long).isEmpty()
    if has_long:
        closing = _by_line(written(closing, "closing-lines"), e.where(long).select("_line").distinct())
    told = known.unionByName(closing.select("kind", "key", F.lit(False).alias("_known"), F.lit(True).alias("_closes")))
    told = told.groupBy("kind", "key").agg(F.bool_or("_known").alias("_known"), F.bool_or("_closes").alias("_closes"))
    # All questions about a text are asked in one join, so that the corpus is gone through once.
    kept = ["doc_id", "source", "ending", "address", "chars", "bytes", "_l"]
    ask = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.col(c).alias("key"))
    asks = [F.array(ask("word", "_word"), ask("line", "_line")), F.transform(_heads(F.col("_line")), lambda h: F.struct(F.lit("head").alias("kind"), h["head"].alias("key")))]
    if has_long:
        asks.append(F.when(long, F.array(F.struct(F.lit("head").alias("kind"), _spaced(F.col("_line")).alias("key")))).otherwise(F.array().cast("array<struct<kind:string,key:string>>")))
    asked = e.select(*kept, F.explode(F.concat(*asks)).alias("_x")).select(*kept, "_x.*")
    asked = asked.join(told, ["kind", "key"], "left")
    has = lambda kind, what: F.coalesce(F.bool_or((F.col("kind") == kind) & F.col(what)), F.lit(False))
    asked = asked.groupBy(*kept).agg(has("word", "_known").alias("_w"), has("line", "_known").alias("_k"), has("line", "_closes").alias("_line"), has("head", "_closes").alias("_head"))
    limited, word_known = F.col("_l").isNotNull(), F.col("_w")
    # What ends with an address is whole if the address is; a closing line's last word may be anything, so at a limit it must be known.
    whole_open = F.when(F.col("address"), word_known).otherwise(F.col("_line") | F.col("_head") & (~limited | word_known)) | F.col("_k") & ~limited
    lost = F.when(F.col("ending") == "place", F.lit(True)).when(F.col("ending") == "short", limited | ~word_known).otherwise(~whole_open)
    return asked.where(lost).select("doc_id", "source", "chars", "bytes", F.col("_l.length").alias("limit"), F.col("_l.unit").alias("unit"), limited.alias("at_limit"))


def truncation_by_source(documents: DataFrame, **options: float) -> DataFrame:
    """(source, texts, truncated, at_limit, share) of every source: how often it truncates."""
    total = documents.groupBy("source").agg(F.count(F.when(_last_line(F.col("text")) != "", 1)).alias("texts"))
    cut = truncated(documents, **options).groupBy("source").agg(F.count(F.lit(1)).alias("truncated"), F.count_if("at_limit").alias("at_limit"))
    j = total.join(cut.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    return j.select("source", "texts", F.coalesce("truncated", F.lit(0)).alias("truncated"), F.coalesce("at_limit", F.lit(0)).alias("at_limit"), F.try_divide(F.coalesce("truncated", F.lit(0)), F.col("texts")).alias("share"))
