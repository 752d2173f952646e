"""Word timings for rewritten lines: kept words keep their times, new ones share the span they replace.

Alignment is a longest-matching-block comparison of word keys, which no built-in expresses; it runs
over Arrow batches, a line per row, and a line is bounded by what one speaker says in one turn.
"""

from __future__ import annotations

import difflib
import unicodedata
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame

RATIO, LEAST_CHARS = 0.88, 4
WORDS = pa.list_(pa.struct([("word", pa.string()), ("start", pa.float64()), ("stop", pa.float64()), ("kept", pa.bool_())]))


def word_key(word: str) -> str:
    return "".join(filter(str.isalnum, unicodedata.normalize("NFKD", word).casefold()))


def pairing(old: list[str], new: list[str]) -> dict[int, int]:
    """New place -> old place: equal keys in matching blocks, then near spellings between the blocks, in order."""
    blocks, pairs, a, b = difflib.SequenceMatcher(None, old, new, autojunk=False).get_matching_blocks(), {}, 0, 0
    for block in blocks:
        for k in range(b, block.b):
            near = [(difflib.SequenceMatcher(None, old[j], new[k]).ratio(), -j) for j in range(a, block.a) if min(len(old[j]), len(new[k])) >= LEAST_CHARS]
            if near and max(near)[0] >= RATIO:
                pairs[k] = -max(near)[1]
                a = pairs[k] + 1
        pairs |= {block.b + k: block.a + k for k in range(block.size)}
        a, b = block.a + block.size, block.b + block.size
    return pairs


def retimed(source: list[tuple[str, float, float]], text: str, start: float, stop: float) -> list[dict]:
    """Timed words of text. A run of new words shares the replaced words' span by key length, else it has no
    width: at the word before, else at the one after; without any source word it takes the whole line.
    """
    words, out = text.split(), []
    keys = [word_key(w) for w in words]
    pairs = pairing([word_key(w) for w, _, _ in source], keys)
    for kept, run in groupby(range(len(words)), pairs.__contains__):
        places = list(run)
        if kept:
            out += [{"word": words[k], "start": round(source[pairs[k]][1], 3), "stop": round(source[pairs[k]][2], 3), "kept": True} for k in places]
            continue
        low, high = pairs.get(places[0] - 1, -1) + 1, pairs.get(places[-1] + 1, len(source))
        if low < high:
            begin, end = source[low][1], source[high - 1][2]
        elif out:
            begin = end = out[-1]["stop"]
        elif source:
            begin = end = source[high][1]
        else:
            begin, end = start, stop
        weights, upto, end = [max(1, len(keys[k])) for k in places], 0, max(begin, end)
        for k, weight in zip(places, weights, strict=True):
            a, upto = begin + (end - begin) * upto / sum(weights), upto + weight
            out.append({"word": words[k], "start": round(a, 3), "stop": round(begin + (end - begin) * upto / sum(weights), 3), "kept": False})
    return out


def retimed_lines(lines: DataFrame, key: str) -> DataFrame:
    """(key, words array<struct<word, start, stop>>, text, start, stop) -> key, words with `kept`. Null words or text: none."""

    def run(batches):
        for b in batches:
            rows = zip(*(b.column(k).to_pylist() for k in range(1, 5)), strict=True)
            got = [retimed([(w["word"], w["start"], w["stop"]) for w in words or []], text or "", start, stop) for words, text, start, stop in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, WORDS)], [key, "words"])

    return lines.select(key, "words", "text", "start", "stop").mapInArrow(run, f"{key} {lines.schema[key].dataType.simpleString()}, words array<struct<word:string,start:double,stop:double,kept:boolean>>")
