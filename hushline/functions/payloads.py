"""Profile payloads out of a model's prose: recovery of JSON, flattening, and the chain of checks.

Recovery and flattening are Python over Arrow batches, one payload per row; the checks and the
de-duplication are DataFrame functions over the records, so their rules stay visible to the planner.
"""

from __future__ import annotations

import json
import re
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the format.
ATTRIBUTES = ("legal", "economic", "relational", "lifestyle", "appearance", "identity", "location", "health", "demographic")
LINE_FIELDS = ("lines", "line_numbers", "evidence_lines", "line_refs")
NO_INFERENCE = r"(?i)^(\[\s*\]|none(\b|;)|no (new|additional|stable|reliable|profile)\b|no speaker(_[ab])?\b|no confirmed (new|personal|economic|specific|demographic|health|legal|relationship)\b)"
GENERIC = r"(?i)^(something|someone|somebody|a person|a name|name here|placeholder( here)?|insert .+ here|unknown|not specified)$"
MOST_RECORDS, MOST_CHARS = 100, 1000

LITERALS = {"true": "true", "True": "true", "false": "false", "False": "false", "null": "null", "None": "null"}
WORD, QUOTE_END = re.compile(r"[^,:\[\]{}\"\n]+"), re.compile(r"'(?=\s*(?:[:,\]}]|\Z))")


def mended(text: str) -> str:
    """One JSON value at the start of text, made whole: what follows it goes, open ends are closed.

    Trailing commas go, a key without a value gets null, brackets close in the order they opened.
    Single quotes become double ones; a bare word is a literal, else a string.
    """
    out, stack, quoted, k = [], [], False, 0
    while k < len(text):
        c = text[k]
        if quoted:
            out.append(text[k : k + 2] if c == "\\" else "\\n" if c == "\n" else c)
            k += c == "\\"
            quoted = c != '"'
        elif c in "]}":
            while stack and stack[-1] != c:  # an inner bracket was left open
                out.append(stack.pop())
            if not stack:
                break
            _trim(out)
            out.append(stack.pop())
            if not stack:
                break
        elif c == "'":
            end = QUOTE_END.search(text, k + 1)
            stop = end.start() if end else len(text)
            out.append(json.dumps(text[k + 1 : stop].replace("\\'", "'"), ensure_ascii=False))
            k = stop
        elif (c.isalpha() or c == "_") and not (text[k - 1 : k].isalnum() or text[k - 1 : k] in (".", "+", "-")):
            word = WORD.match(text, k)[0]
            out.append(LITERALS.get(word.strip()) or json.dumps(word.strip(), ensure_ascii=False))
            k += len(word) - 1
        else:
            quoted = c == '"'
            if c in "[{":
                stack.append("]" if c == "[" else "}")
            out.append(c)
        k += 1
    if quoted:
        out.append('"')
    while stack:
        _trim(out)
        out.append(stack.pop())
    return "".join(out)


def _trim(out: list[str]) -> None:
    while out and out[-1].isspace():
        out.pop()
    if out and out[-1] == ",":
        out.pop()
    elif out and out[-1] == ":":
        out.append("null")


def recover(text: str | None) -> tuple[Any, str]:
    """(value, status) of the first bracket that begins an object with keys or a list with an object.

    valid: the rest of the text is that JSON; repaired: it had to be mended; valid_empty: only empty
    lists; malformed: nothing. Null and empty texts are malformed.
    """
    text, empty = text or "", False
    for k in (k for k, c in enumerate(text) if c in "[{"):
        for status, candidate in (("valid", text[k:]), ("repaired", mended(text[k:]))):
            try:
                value = json.loads(candidate)
            except (ValueError, RecursionError):
                continue
            if value and (isinstance(value, dict) or isinstance(value, list) and any(isinstance(x, dict) for x in value)):
                return value, status
            empty |= value == []
            break
    return ([], "valid_empty") if empty else (None, "malformed")


def flatten(payload: Any) -> list[Any] | None:
    """Records of any of the four shapes; None where an attribute's values are no list."""
    while isinstance(payload, dict) and (wrapped := next((k for k in ("inferences", "records") if k in payload), None)):
        payload = payload[wrapped]
    if isinstance(payload, dict):
        if isinstance(payload.get("speakers"), list):
            payload = payload["speakers"]
        elif payload and all(isinstance(x, dict) for x in payload.values()):
            payload = [{"speaker": who, **said} for who, said in payload.items()]
        else:
            payload = [payload]
    if not isinstance(payload, list):
        return None
    records = []
    for x in payload:
        slots = [k for k in x if k not in ("speaker", "attribute", "guess", "reasoning")] if isinstance(x, dict) and isinstance(x.get("speaker"), str) and "attribute" not in x else []
        if not slots:
            records.append(x)
        for slot in slots:
            if not isinstance(x[slot], list):
                return None
            records += [{"speaker": x["speaker"], "attribute": slot} | (v if isinstance(v, dict) else {"guess": v}) for v in x[slot]]
    return records


def _row(x: Any) -> dict:
    if not isinstance(x, dict):
        return {"is_object": False}
    texts = {k: x[k] if isinstance(x.get(k), str) else None for k in ("speaker", "attribute", "guess", "reasoning")}
    fields = [x[f] for f in LINE_FIELDS if f in x]
    whole = all(isinstance(f, list) and all(isinstance(v, int) for v in f) for f in fields)
    return texts | {"is_object": True, "lines_fine": whole, "lines": [v for f in fields for v in f if -(1 << 63) <= v < 1 << 63] if whole and fields else None}


RECORD = pa.struct([("is_object", pa.bool_()), ("speaker", pa.string()), ("attribute", pa.string()), ("guess", pa.string()), ("reasoning", pa.string()), ("lines_fine", pa.bool_()), ("lines", pa.list_(pa.int64()))])


def recovered(payloads: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text) -> one row each: key, json_status, status, records.

    status: valid_empty, malformed (nothing recovered, a wrong shape, over MOST_RECORDS) or records.
    """

    def run(batches):
        for b in batches:
            json_status, status, records = [], [], []
            for x in b.column(1).to_pylist():
                value, how = recover(x)
                rows = [] if value in (None, []) else flatten(value)
                fine = rows is not None and len(rows) <= MOST_RECORDS
                json_status.append(how)
                status.append(how if value in (None, []) else "records" if fine else "malformed")
                records.append([_row(r) for r in rows] if fine else [])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(json_status, pa.string()), pa.array(status, pa.string()), pa.array(records, pa.list_(RECORD))], [key, "json_status", "status", "records"])

    shape = "struct<is_object:boolean,speaker:string,attribute:string,guess:string,reasoning:string,lines_fine:boolean,lines:array<bigint>>"
    return payloads.select(key, text).mapInArrow(run, f"{key} {payloads.schema[key].dataType.simpleString()}, json_status string, status string, records array<{shape}>")


def speaker_key(name: F.Column) -> F.Column:
    """Lower case, other characters to one underscore, any number of `speaker_` in front to one; empty stays empty."""
    bare = F.regexp_replace(F.trim(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "_"), F.lit("_")), "^(speaker_)+", "")
    return F.when(bare == "", "").otherwise(F.concat(F.lit("speaker_"), bare))


def validated(found: DataFrame, key: str, allowed: F.Column | None = None) -> DataFrame:
    """recovered() -> a row per record: key, at, speaker, attribute, guess, reasoning, reason (null: accepted).

    The first failing check is the reason. Of equal guesses (case and white space apart) for one
    speaker and attribute the first accepted stays. `allowed`: array of line numbers, else any.
    """
    r = found.select(key, *([allowed.alias("_allowed")] if allowed is not None else []), F.posexplode("records").alias("at", "r"))
    guess, speaker, attribute = F.trim("r.guess"), speaker_key(F.col("r.speaker")), F.lower(F.trim("r.attribute"))
    wrong_lines = ~F.col("r.lines_fine")
    if allowed is not None:
        wrong_lines = wrong_lines | F.coalesce(F.size(F.array_except("r.lines", "_allowed")) > 0, F.lit(False))
    chain = [
        (~F.col("r.is_object"), "not an object"), (F.coalesce(F.trim("r.speaker"), F.lit("")) == "", "speaker missing"), (F.coalesce(attribute, F.lit("")) == "", "attribute missing"),
        (F.coalesce(guess, F.lit("")) == "", "guess missing"), (speaker == "", "speaker empty"), (~attribute.isin(*ATTRIBUTES), "unknown attribute"), (F.length(guess) > MOST_CHARS, "guess too long"),
        (guess.rlike(NO_INFERENCE), "no inference"), (guess.rlike(GENERIC), "generic guess"), (wrong_lines, "line references"),
    ]
    reason = F.coalesce(*[F.when(test, F.lit(name)) for test, name in chain])
    checked = r.select(key, "at", speaker.alias("speaker"), attribute.alias("attribute"), guess.alias("guess"), F.coalesce("r.reasoning", F.lit("")).alias("reasoning"), reason.alias("reason"))
    same = Window.partitionBy(key, "speaker", "attribute", F.lower(F.regexp_replace("guess", r"\s+", " ")), F.col("reason").isNull()).orderBy("at")
    return checked.withColumn("reason", F.when(F.col("reason").isNull() & (F.row_number().over(same) > 1), "duplicate").otherwise(F.col("reason")))
