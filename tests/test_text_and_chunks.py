import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.functions.text import count_occurrences, has_text, strip, tokenize
from corpusloom.operators import chunking
from corpusloom.operators.chunking import BOUNDARY_MARKS, LOOK_BACK, windows


def words(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(tokenize(F.col("t"))).first()[0]


def test_han_text_becomes_bigrams(spark):
    got = words(spark, "什么是混合检索")
    assert "混合" in got and "检索" in got
    assert got == ["什么", "么是", "是混", "混合", "合检", "检索"]


def test_latin_words_stay_whole(spark):
    assert words(spark, "混合检索 Python api_2!") == ["混合", "合检", "检索", "python", "api_2"]
    assert words(spark, "用python做 x") == ["用", "python", "做", "x"]
    assert words(spark, "Où, the END.") == ["où", "the", "end"]
    assert words(spark, " ,. ") == []


def test_strip_knows_unicode_blanks(spark):
    rows = spark.createDataFrame([("\u3000\t a b\u2003\n",), ("\u00a0\u2028",)], "t string")
    got = rows.select(strip(F.col("t")), has_text(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [("a b", True), ("", False)]


def test_occurrences_ignore_case_and_overlap(spark):
    rows = spark.createDataFrame([("aAaA banana",)], "t string")
    assert rows.select(count_occurrences(F.col("t"), F.lit("AA")),
                       count_occurrences(F.col("t"), F.lit("an"))).first() == (2, 2)


def model(text, size, overlap):
    """The chunk rule, spelled out position by position."""
    if len(text) <= size:
        return [text] if text.strip() else []
    out, at = [], 0
    while at < len(text):
        stop = at + size
        if stop < len(text):
            low = max(at, stop - LOOK_BACK)
            for mark in BOUNDARY_MARKS:
                ends = [i + len(mark) for i in range(low, stop - len(mark) + 1)
                        if text[i:i + len(mark)] == mark]
                if ends:
                    stop = ends[-1]
                    break
        if text[at:stop].strip():
            out.append(text[at:stop].strip())
        at = stop - overlap
    return out


@pytest.mark.parametrize("length", [0, 1, 499, 500, 501, 950, 1000, 1450, 3000])
@pytest.mark.parametrize("size,overlap", [(500, 50), (500, 0), (300, 30), (200, 50)])
def test_windows_follow_the_rule(length, size, overlap):
    rng = random.Random(length * 7 + size)
    for alphabet in ("ab", "ab .\n", "字。，； ", " \n"):
        text = "".join(rng.choice(alphabet) for _ in range(length))
        assert list(windows(text, size, overlap, False)) == model(text, size, overlap)


def test_first_mark_in_the_list_beats_a_closer_one():
    text = "x" * 401 + "\n" + "y" * 97 + "." + "z" * 300
    assert list(windows(text, 500, 50, False))[0] == "x" * 401
    text = "x" * 405 + "。" + "y" * 80 + "." + "z" * 300
    assert list(windows(text, 500, 50, False))[0] == "x" * 405 + "。"


def test_contained_tail_is_kept_unless_asked():
    text = "x" * 500 + "y" * 430
    plain, cut = list(windows(text, 500, 50, False)), list(windows(text, 500, 50, True))
    assert plain[:-1] == cut and plain[-1] in plain[-2]


def test_chunks_cover_the_text_and_stay_short():
    rng = random.Random(3)
    text = "".join(rng.choice("abc.,\n ") for _ in range(9000))
    parts = list(windows(text, 500, 50, False))
    assert all(0 < len(p) <= 500 for p in parts)
    at = 0
    for part in parts:
        found = text.find(part, max(0, at - 600))
        assert found >= 0 and text[at:found].strip() == ""
        at = max(at, found + len(part))
    assert text[at:].strip() == ""


@pytest.mark.parametrize("size,overlap", [(100, 10), (149, 50), (0, 0), (500, -1)])
def test_windows_that_cannot_progress_are_refused(size, overlap):
    with pytest.raises(ValueError):
        chunking.check_window(size, overlap)


def blocks(spark, rows):
    return spark.createDataFrame(
        rows, "kb_id string, doc_id string, text string, page int, source string, "
              "type string, image string")


def test_chunk_index_restarts_per_block_and_ids_stay_unique(spark):
    long = "word " * 300
    got = chunking.chunk_blocks(blocks(spark, [
        ("k", "d", long, 1, "d.pdf", "text", None), ("k", "d", long, 2, "d.pdf", None, None),
        ("k", "e", "  ", None, "e.md", "text", None),
        ("k", "f", "pic", None, "f.png", "image", "/f.png")])).collect()
    by_page = {}
    for r in got:
        by_page.setdefault((r.doc_id, r.page), []).append(r.chunk_index)
    assert sorted(by_page[("d", 1)]) == sorted(by_page[("d", 2)]) == list(range(4))
    assert len({r.chunk_id for r in got}) == len(got)
    assert len({r.chunk_label for r in got}) < len(got)
    assert {r.type for r in got if r.doc_id == "d"} == {"text"}
    assert [(r.type, r.image) for r in got if r.doc_id == "f"] == [("image", "/f.png")]
    assert not [r for r in got if r.doc_id == "e"]


def test_sweep_equals_single_runs(spark):
    rng = random.Random(5)
    rows = blocks(spark, [("k", str(i), "".join(rng.choice("ab .\n") for _ in range(1700)), None,
                           "s", "text", None) for i in range(5)])
    settings = [(500, 0), (300, 30)]
    swept = chunking.sweep_windows(rows, settings).collect()
    for size, overlap in settings:
        single = chunking.chunk_blocks(rows, size, overlap).collect()
        assert sorted((r.doc_id, r.chunk_index, r.content) for r in single) == sorted(
            (r.doc_id, r.chunk_index, r.content) for r in swept if r.chunk_size == size)


def test_a_batch_of_texts_is_taken_as_strings_in_slices():
    texts = pa.array(["a" * 30, None, "", "b" * 90, "ä" * 10, "c"])
    slices = list(chunking.byte_slices(texts, 40))
    assert [x for part in slices for x in part.to_pylist()] == texts.to_pylist()
    assert [len(part) for part in slices] == [3, 3] and list(chunking.byte_slices(texts.slice(0, 0))) == []
