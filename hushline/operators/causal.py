"""The causal loop: each window of a conversation is profiled and rewritten with what earlier windows taught.

infer -> validate -> append to the profile -> retrieve earlier edits -> rewrite -> check and apply
edits -> remember them. A window needs its predecessors' results, so a conversation is one
sequential fold in Arrow, grouped by its key; conversations run side by side. Models are injected.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hushline.functions.payloads import ATTRIBUTES, GENERIC, MOST_CHARS, MOST_RECORDS, NO_INFERENCE, _row, flatten, recover
from hushline.operators.windows import BUDGET

# The forms of edits and labels, the sentinel, the limits of retrieval and of growth.
EDIT = re.compile(r"^edit\s+(\d+)\s*(.*)$", re.IGNORECASE)
LABEL = re.compile(r"^\s*([A-Za-z_][\w .-]*?)\s*:\s*(.*)$")
SPEAKER_LABEL = re.compile(r"^speaker(?:[ _.-]|$)", re.IGNORECASE)
NOTHING = "none yet, this is the first window."
THRESHOLD, CANDIDATES, TOP, CONTEXT, GROWTH = 0.3, 20, 8, 2, 2.5

LINE = pa.struct([("line_no", pa.int64()), ("before", pa.string()), ("after", pa.string())])
FACT = pa.struct([(k, pa.string()) for k in ("speaker", "attribute", "guess", "reasoning")])
OUT = [("window_id", pa.int64()), ("lines", pa.list_(LINE)), ("facts", pa.list_(FACT)), ("retrieved", pa.list_(pa.string())), ("errors", pa.list_(pa.string()))]
SHAPE = "window_id long, lines array<struct<line_no:long,before:string,after:string>>, facts array<struct<speaker:string,attribute:string,guess:string,reasoning:string>>, retrieved array<string>, errors array<string>"


@dataclass
class Models:
    """infer(window, profile) and rewrite(window, profile, examples) give prose; embed gives unit rows."""

    infer: Callable[[str, str], str]
    rewrite: Callable[[str, str, str], str]
    embed: Callable[[list[str]], np.ndarray]


def key_of(speaker: str) -> str:
    bare = re.sub(r"^(speaker_)+", "", re.sub(r"[^a-z0-9]+", "_", speaker.strip().lower()).strip("_"))
    return f"speaker_{bare}" if bare else ""


@dataclass
class Conversation:
    """What a conversation has taught so far; `step` takes its windows in order."""

    models: Models
    facts: list[dict] = field(default_factory=list)
    seen: set[tuple] = field(default_factory=set)
    known: dict[int, str] = field(default_factory=dict)
    edits: list[tuple[int, str, str]] = field(default_factory=list)
    vectors: list[np.ndarray] = field(default_factory=list)

    def learn(self, prose: str, numbers: set[int], errors: list[str]) -> list[dict]:
        """New facts of a payload: of a known attribute, not void or generic, on lines of the window, not known yet."""
        value, status = recover(prose)
        rows = [] if value == [] else None if value is None else flatten(value)
        if rows is None or len(rows) > MOST_RECORDS:
            errors.append(f"payload: {status if value is None else 'wrong shape'}")
            return []
        new = []
        for k, x in enumerate(rows):
            r = _row(x)
            said = {c: (r.get(c) or "").strip() for c in ("speaker", "attribute", "guess", "reasoning")}
            said |= {"speaker": key_of(said["speaker"]), "attribute": said["attribute"].lower()}
            fine = said["speaker"] and said["attribute"] in ATTRIBUTES and 0 < len(said["guess"]) <= MOST_CHARS and not re.search(NO_INFERENCE, said["guess"]) and not re.search(GENERIC, said["guess"])
            if not fine or not r.get("lines_fine") or set(r.get("lines") or ()) - numbers:
                errors.append(f"record {k}: rejected")
                continue
            same = (said["speaker"], said["attribute"], " ".join(said["guess"].lower().split()))
            if same not in self.seen:
                self.seen.add(same)
                new.append(said)
        self.facts += new
        return new

    def examples(self, current: dict[int, tuple[str, str]]) -> str:
        """Earlier edits of lines like these, each once, the closest last, between their neighbours as first seen."""
        texts = [text for _, text in current.values() if text]
        if not self.edits or not texts:
            return NOTHING
        best: dict[int, float] = {}
        for row in self.models.embed(texts) @ np.vstack(self.vectors).T:
            near = [int(k) for k in np.argsort(-row, kind="stable")[:CANDIDATES] if row[k] >= THRESHOLD]
            for k in near[:TOP]:
                best[k] = max(best.get(k, -1.0), float(row[k]))
        return "\n\n".join(self.render(*self.edits[k]) for k in sorted(best, key=lambda k: (best[k], k))) or NOTHING

    def render(self, number: int, before: str, after: str) -> str:
        around = [[f"[{k}] {self.known[k]}" for k in places if k in self.known] for places in (range(number - CONTEXT, number), range(number + 1, number + CONTEXT + 1))]
        return "\n".join([*around[0], f"Original: {before}", f"Changed: {after}", *around[1]])

    def apply(self, prose: str, current: dict[int, tuple[str, str]], errors: list[str]) -> None:
        """The last edit of each line takes effect: an empty one deletes it; none changes the speaker or grows a line too far."""
        proposed = {int(m[1]): m[2].strip() for raw in prose.splitlines() if (m := EDIT.match(raw.strip()))}
        landed = []
        for n, body in proposed.items():
            if n not in current:
                errors.append(f"edit {n}: outside the window")
                continue
            speaker, text = current[n]
            body = body.removeprefix(":").lstrip()
            if not body:
                del current[n]
                continue
            label = LABEL.match(body)
            if label and SPEAKER_LABEL.match(label[1]):
                body = label[2].strip()
                if key_of(label[1]) != key_of(speaker):
                    errors.append(f"edit {n}: speaker repaired")
            else:
                errors.append(f"edit {n}: speaker label missing")
            if body == text:
                continue
            if len(f"{speaker}: {body}") > GROWTH * len(f"{speaker}: {text}"):
                errors.append(f"edit {n}: too long")
                continue
            current[n] = (speaker, body)
            landed.append((n, f"{speaker}: {text}", f"{speaker}: {body}", text))
        if landed:
            self.vectors.append(self.models.embed([x[3] for x in landed]))
            self.edits += [x[:3] for x in landed]

    def step(self, lines: dict[int, tuple[str, str]], passes: int = 1) -> dict:
        """Lines (number -> speaker, text) of one window. A model that fails leaves the window as it is, with an error."""
        current, facts, retrieved, errors = dict(lines), [], [], []
        for n, (speaker, text) in lines.items():
            self.known.setdefault(n, f"{speaker}: {text}")

        def call(what: str, *prompt: str) -> str | None:
            try:
                return getattr(self.models, what)(*prompt)
            except Exception as e:  # an injected model may fail in any way; the error is part of the result
                errors.append(f"{what}: {type(e).__name__}: {e}")
                return None

        for _ in range(passes):
            window = "\n".join(f"{n}: {s}: {t}" for n, (s, t) in current.items())
            prose = call("infer", window, json.dumps(self.facts, indent=2, ensure_ascii=False))
            facts += [] if prose is None else self.learn(prose, set(lines), errors)
            retrieved.append(self.examples(current))
            prose = call("rewrite", window, json.dumps(self.facts, indent=2, ensure_ascii=False), retrieved[-1])
            if prose is not None:
                self.apply(prose, current, errors)
        after = [{"line_no": n, "before": f"{s}: {t}", "after": f"{current[n][0]}: {current[n][1]}" if n in current else None} for n, (s, t) in lines.items()]
        return {"lines": after, "facts": facts, "retrieved": retrieved, "errors": errors}


def split(rows: list[tuple], budget: int) -> list[list[tuple]]:
    """Rows (.., tokens last) in greedy windows within the budget; a larger row is a window of its own."""
    out, used = [], 0
    for r in rows:
        if not out or used + r[-1] > budget:
            out.append([])
            used = 0
        out[-1].append(r)
        used += r[-1]
    return out


def causal_loop(lines: DataFrame, models: Callable[[], Models], key: str = "conv_id", budget: int = BUDGET, passes: int = 1) -> DataFrame:
    """(key, line_no, speaker, text, tokens) -> a row per window: key, window_id, lines, facts, retrieved, errors.

    `models` is called on the executor. Null texts are empty, null speakers `speaker_a`; of rows
    with one line number the last by text stays. A group is one conversation.
    """

    def run(table: pa.Table) -> pa.Table:
        columns = [table.column(c).to_pylist() for c in ("line_no", "speaker", "text", "tokens")]
        own = sorted((n, s or "speaker_a", t or "", k or 0) for n, s, t, k in zip(*columns, strict=True))
        rows = list({r[0]: r for r in own}.values())
        talk = Conversation(models())
        got = [{"window_id": w} | talk.step({n: (s, t) for n, s, t, _ in part}, passes) for w, part in enumerate(split(rows, budget))]
        keys = pa.array([table.column(key)[0].as_py()] * len(got), table.schema.field(key).type)
        return pa.Table.from_arrays([keys, *[pa.array([g[c] for g in got], t) for c, t in OUT]], [key, *[c for c, _ in OUT]])

    own = lines.where("line_no IS NOT NULL").select(key, "line_no", "speaker", "text", "tokens")
    return own.groupBy(key).applyInArrow(run, f"{key} {lines.schema[key].dataType.simpleString()}, {SHAPE}")
