"""Problem 8 on a small corpus whose cuts are known."""

import random

from strandloom.llm import truncation
from strandloom.llm.truncation import closing_lines, field_limits, truncated, truncation_by_source

SCHEMA = "doc_id long, source string, text string, kind string, length long, _last string"


def corpus():
    draw = random.Random(8)
    nouns = ["the map", "a wooden box", "my letters", "the red boat", "the last train"]
    ends = ["before the storm", "in the morning", "again", "without a word"]

    def cue(k):
        said = draw.choice([f"The captain sold {draw.choice(nouns)} {draw.choice(ends)}{draw.choice(['.', '!', '?', '...'])}", "[laughter]", "Subtitles by Team Walnut", "♪ They kept the map again ♪"])
        return f"{k}\n00:00:{k % 60:02d},100 --> 00:00:{k % 60:02d},900\n{said}"

    whole = lambda: "\n\n".join(cue(k) for k in range(1, draw.randrange(3, 30)))
    rows, lost = [], set()
    for i in range(900):
        source, text, kind = draw.choice(["field", "clean", "broken"]), whole(), "whole"
        if source == "field" and len(text) > 600:
            text = text[:600]
            kind = "limit"
        elif source == "broken" and i % 5 == 0:
            text = text[: draw.randrange(40, len(text))]
            kind = "broken"
        rows.append((i, source, text, kind, 1, "clash"))
    return rows, lost


def test_significant_length_and_cut_texts(spark):
    rows, _ = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    limits = {(r.source, r.unit, r.length) for r in field_limits(df).collect()}
    assert ("field", "chars", 600) in limits
    assert all(source == "field" for source, _, _ in limits)
    found = {r.doc_id for r in truncated(df).collect()}
    # A cut right behind a closed sentence cannot be told and is no case.
    closed = lambda t: t.rstrip().endswith((".", "!", "?", "]", "♪", "Walnut"))
    expected = {i for i, _, t, kind, *_ in rows if kind != "whole" and not closed(t)}
    assert not {i for i in found if rows[i][3] == "whole"}
    assert len(found & expected) >= 0.97 * len(expected)


def test_endings_one_by_one(spark):
    body = "1\n00:00:01,000 --> 00:00:02,000\nI sold the map.\n\n" * 5
    head = "2\n00:00:03,000 --> 00:00:04,000\n"
    whole = ["I sold the map.", "I sold the map...", "Wait, I—", "[door slams]", "♪ La la ♪", "THE END", "Part 7", "Translation: Someone", "<i>He left!</i>", 'He said "go."', "また明日。"]
    cut = ["I sold the", "I sold the m...", "[door sl", "♪ La la", "<i>He lef", "<i"]
    texts = [body + head + x for x in whole] + [body + head + x for x in cut] + [body + "2", body + "2\n00:00:03,0", body + "2\n00:00:03,000 --> 00:0", body + "2\n00:00:03,000 --> 00:00:04,000\n", None, "", " \r\n\t"]
    # What closes texts is learnt from other texts of the corpus.
    names = ["Ann", "Bo", "Cleo", "Dan", "Eve", "Finn", "Gus", "Hal"]
    said = lambda k: "".join(f"1\n00:00:01,000 --> 00:00:02,000\nI sold map {k} of {j}.\n\n" for j in range(60))
    taught = [said(k) + head + x for k in range(8) for x in ("THE END", f"Part {k}", f"Translation: {names[k]}")]
    df = spark.createDataFrame([(i, None if i % 2 else "s", t, None, None, None) for i, t in enumerate(texts + taught)], SCHEMA)
    n = len(whole)
    assert sorted(r.doc_id for r in truncated(df).collect()) == list(range(n, n + len(cut) + 4))
    # A beginning of a closing line closes nothing, however often it is left.
    left = [said(k) + head + x for k in range(20, 24) for x in ("THE", "Transl", "Translation:")]
    df = df.unionByName(spark.createDataFrame([(1000 + i, "s", t, None, None, None) for i, t in enumerate(left)], SCHEMA))
    assert {r.doc_id for r in truncated(df).collect()} >= {1000 + i for i in range(len(left))}


def test_more_of_the_same_changes_nothing(spark):
    rows, _ = corpus()
    head = lambda k: f"{k}\n00:00:0{k},000 --> 00:00:0{k},900\n"
    # Sentences over two cues, whose first halves are frequent but never an end.
    for i, (a, b) in enumerate([("The doctor was hiding", "the map again."), ("The doctor was hiding", "my letters..."), ("The doctor was hiding", "a wooden box!"), ("The doctor was hiding", "the red boat?")]):
        rows.append((2000 + i, "clean", head(1) + a + "\n\n" + head(2) + b + f"\n\n{head(3)}I sold {i} boxes.", "whole", 1, ""))
    rows.append((3000, "clean", head(1) + "Again.\n\n" + head(2) + "The doctor was hiding", "broken", 1, ""))
    rows.append((3001, "clean", head(1) + "Again.\n\n" + head(2) + "My brother was hiding...", "broken", 1, ""))
    found = {r.doc_id for r in truncated(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {3000, 3001} <= found
    assert not {2000, 2001, 2002, 2003} & found
    copies = spark.createDataFrame([(i + 10_000 * k, *rest) for i, *rest in rows for k in range(10)], SCHEMA)
    again = [r.doc_id for r in truncated(copies).collect()]
    assert sorted(again) == sorted(i + 10_000 * k for i in found for k in range(10))


def test_share_of_each_source(spark):
    rows, _ = corpus()
    by = {r.source: r for r in truncation_by_source(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert by["clean"].truncated == 0
    assert by["field"].share > by["broken"].share > 0
    assert sum(r.texts for r in by.values()) == len(rows)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert truncated(empty).count() == 0
    assert truncation_by_source(empty).count() == 0


def test_closing_lines_of_any_length(spark):
    said = lambda k: "".join(f"1\n00:00:01,000 --> 00:00:02,000\nI sold map {k} of {j}.\n\n" for j in range(60 + 3 * k))
    names = ["Ann", "Bo", "Cleo", "Dan", "Eve", "Finn", "Gus", "Hal"]
    same = "This recording was made for everyone who " + "sings and " * 30 + "dances"
    credit = "Words set down with " + "great care and " * 20 + "patience by"
    # Lines of over 200 characters: the same, with a long head before the names, and with a short head before long lists.
    taught = [x for k in range(8) for x in (same, f"{credit} {names[k]}", f"{credit} {names[k]} and their friends", "Helpers: " + ", ".join(names[k:] + names[:k] + [f"{n}{m}" for n in names for m in "abcdef"]))]
    left = [same[:250], credit, credit[:230].rsplit(" ", 1)[0]]
    rows = [(i, said(i) + "2\n00:00:03,000 --> 00:00:04,000\n" + x) for i, x in enumerate(taught + left)]
    df = spark.createDataFrame([(i, "s", t, None, None, None) for i, t in rows], SCHEMA)
    assert sorted(r.doc_id for r in truncated(df).collect()) == [len(taught) + k for k in range(len(left))]


def test_sorted_lines_tell_what_all_beginnings_tell(spark, monkeypatch):
    draw = random.Random(5)
    line = lambda: "".join(draw.choice(["a", "b", "é", "a\x01", "bb"]) + draw.choice([" ", " ", "  ", ""]) for _ in range(draw.randrange(1, 8))).strip()
    lines = [line() for _ in range(150)]
    ends = spark.createDataFrame([(i, draw.choice(["open", "open", "open", "closed"]), draw.choice(lines)) for i in range(900)], "_h long, ending string, _line string")
    lined = [("line", x, draw.randrange(1, 9), 0) for x in sorted({*draw.sample(lines, 60), *(line() for _ in range(60))})]
    uses = spark.createDataFrame([("word", "x", 30_000, 0), ("first", "a", 40, 0), *lined], "kind string, key string, uses long, whole long")
    texts = [(i, "s", "1\n00:00:01,000 --> 00:00:02,000\n" + "I sold it.\n\n" * 30 + draw.choice(lines), None, None, None) for i in range(300)]
    documents = spark.createDataFrame(texts, SCHEMA)
    found = {}
    for longest in (1000, 0, 3):
        monkeypatch.setattr(truncation, "LONGEST_LINE", longest)
        told = closing_lines(ends, uses).collect()
        assert len(told) == len(set(told))
        found[longest] = ({(r.kind, r.key) for r in told}, {r.doc_id for r in truncated(documents).collect()})
    assert len({kind for kind, _ in found[1000][0]}) == 2 and found[1000][1]
    assert found[0] == found[3] == found[1000]
