"""Clean, ordered speaker turns from captions.

The distinct cues of a transcript are nodes of a precedence graph. Its edges
have weights: the clock (a cue that starts earlier comes first) outranks
everything; between cues that start together the cue edges (the one that ends
first comes first) and the dialogue edges (the order of delivery) decide, and
which of the two is stronger depends on the kind of captions: people deliver
lines in the order of the dialogue, machines by their cues. Edges are taken
from the strongest down, and an edge that would close a cycle, the weakest of
it, is dropped; the graph that is left is ordered topologically. Repeated cues
are one node.

Each cue is then split into clock times, change marks, a label and clean text.
Labels are matched with the billed names in their usual spellings; numbers
count in billing order. A cue without words after cleaning changes nothing; a
word set in italics that is all of its cue is a sound note.

Defined results: null or empty utterances and null texts give no turn; without
billed names there is no turn; unlabelled openings belong to the first billed;
a bare change mark passes to the other of two speakers, and with more than two
back to the previous speaker (else the next billed); of several versions of a
transcript the highest counts, of several contents of one version the one of
greatest hash.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CLOCK = re.compile(r"[\[(<]\s*(?:\d+:)?\d{1,2}:\d{2}(?:[.,]\d+)?\s*[\])>]|(?<![\w:])\d{1,2}:\d{2}:\d{2}(?:[.,]\d+)?(?![\w:])")
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_SOUND = re.compile(r"\[[^\[\]]*\]|\*[^*]{1,60}\*|♪[^♪]*♪|[♪♫]+|\((?:[^()\d]{1,40})\)")
_FILLER = re.compile(
    r"(?<![\w'])(?:u+m+|u+h+m*|h+m+|m+h*m+|e+r+m*|a+h+|e+h+|you know|i mean)(?![\w'])(?:\s*(?:,|\.\.\.|…))?",
    re.I,
)
_MARK = re.compile(r"^\s*(?:>>+|»+|--?(?=\s)|—)\s*")
_NUMBERED = re.compile(r"^(?:speaker|spkr?|s|voice|person)\s*#?\s*(\d{1,2})$", re.I)
_TITLE = re.compile(r"^(?:dr|mr|mrs|ms|prof|professor|sir)\.?\s+", re.I)
#: Forms of a label; the first that names a speaker counts.
_LABELS = [
    re.compile(r"^\s*" + form + r"\s*")
    for form in (
        r"\[([^\[\]]{1,60})\]\s*:?", r"\(([^()]{1,60})\)\s*:?", r"([^:\[\]()<>]{1,60}?)\s*:(?=\s|$)",
        r"([^:\[\]()<>\-–—]{1,60}?)\s+[-–—](?=\s|$)",
    )
]
_ITALIC_CUE = re.compile(r"^\s*<(i|em)>[^<>]*</\1>\s*$", re.I)
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"\w")


def cue_order(cues: list[tuple[int, int, str]], kind: str | None = None) -> list[int]:
    """Positions of the distinct cues (start, end, text) in dialogue order."""
    first: dict[tuple, int] = {}
    for i, cue in enumerate(cues):
        first.setdefault(cue, i)
    together: dict[int, list[int]] = {}
    for i in first.values():
        together.setdefault(cues[i][0], []).append(i)
    # the clock's edges join every cue of a start to every cue of the next one,
    # so each start is ordered on its own
    return [i for start in sorted(together) for i in _resolve(sorted(together[start]), cues, kind)]


def _resolve(nodes: list[int], cues: list[tuple[int, int, str]], kind: str | None) -> list[int]:
    """Topological order of cues that start together."""
    if len(nodes) < 2:
        return nodes
    dialogue, cue = (2, 1) if (kind or "").strip().lower() == "human" else (1, 2)
    edges = [(dialogue, a, b) for a, b in zip(nodes, nodes[1:])]
    by_end = sorted(nodes, key=lambda i: (cues[i][1], i))
    edges += [(cue, a, b) for a, b in zip(by_end, by_end[1:]) if cues[a][1] < cues[b][1]]
    after: dict[int, set[int]] = {i: set() for i in nodes}
    for _, a, b in sorted(edges, key=lambda e: (-e[0], e[1], e[2])):
        if not _reaches(after, b, a):
            after[a].add(b)
    waits = {i: 0 for i in nodes}
    for targets in after.values():
        for b in targets:
            waits[b] += 1
    ready = [i for i in nodes if not waits[i]]
    heapq.heapify(ready)
    out = []
    while ready:
        i = heapq.heappop(ready)
        out.append(i)
        for b in after[i]:
            waits[b] -= 1
            if not waits[b]:
                heapq.heappush(ready, b)
    return out


def _reaches(after: dict[int, set[int]], a: int, b: int) -> bool:
    """Whether a path leads from a to b."""
    seen, stack = {a}, [a]
    while stack:
        x = stack.pop()
        if x == b:
            return True
        new = after[x] - seen
        seen |= new
        stack += new
    return False


def _flat(name: str) -> str:
    return _SPACE.sub(" ", name.replace(".", ". ").replace(" ,", ",")).strip().lower()


def name_index(speakers: list[str]) -> dict[str, int]:
    """Spellings of the billed names; one that fits two names is left out."""
    found: dict[str, set[int]] = {}
    for i, full in enumerate(speakers):
        words = _SPACE.sub(" ", full).strip().split(" ")
        first, last = words[0], words[-1]
        forms = {" ".join(words)}
        if len(words) > 1:
            forms |= {
                first, last, f"{last}, {first}", f"{first[0]}. {last}", f"{first[0]} {last}",
                f"{first} {last[0]}.", f"{first[0]}. {last[0]}.", f"{last} {first}", f"{last}, {first[0]}.",
            }
        for f in forms:
            found.setdefault(_flat(f), set()).add(i)
    return {f: next(iter(s)) for f, s in found.items() if len(s) == 1}


def _named(label: str, names: dict[str, int], billed: int, base: int) -> int | None:
    """Billed place of the speaker a label names."""
    number = _NUMBERED.match(label.strip())
    if number:
        who = int(number.group(1)) - base
        return who if 0 <= who < billed else None
    who = names.get(_flat(label))
    return names.get(_flat(_TITLE.sub("", label.strip()))) if who is None else who


def split_cue(text: str, names: dict[str, int], billed: int, base: int) -> tuple[int | None, bool, str]:
    """Speaker of the label, whether a change mark stands, and clean text."""
    t = _CLOCK.sub(" ", text)
    speaker, mark = None, False
    for _ in range(3):
        m = _MARK.match(t)
        if m and m.end():
            mark, t = True, t[m.end():]
            continue
        if speaker is not None:
            break
        bare = _TAG.sub(" ", t)
        for form in _LABELS:
            m = form.match(bare)
            speaker = _named(m.group(1), names, billed, base) if m else None
            if speaker is not None:
                break
        if speaker is None:
            break
        # the tags stay behind the label, where they may set a sound note
        plain = form.match(t)
        t = t[plain.end():] if plain and _named(plain.group(1), names, billed, base) == speaker else bare[m.end():]
    if _ITALIC_CUE.match(t):
        return speaker, mark, ""
    t = _TAG.sub(" ", t)
    t = _SOUND.sub(" ", t)
    t = _FILLER.sub(" ", t)
    t = _SPACE.sub(" ", t)
    t = re.sub(r"\s+([,.;:!?…])", r"\1", t)
    t = re.sub(r"^[\s,;:…]+|([,;])(?=[,;.!?])", "", t).strip()
    return speaker, mark, t if _WORD.search(t) else ""


def turns(speakers, utterances, kind: str | None = None) -> list[tuple[int, int, str, str]]:
    """start_ms, end_ms, speaker, text of one transcript's turns."""
    billed = [s for s in (speakers if speakers is not None else []) if s and s.strip()]
    if not billed or utterances is None:
        return []
    cues = [
        (int(u["start_ms"]), int(u["end_ms"] if u["end_ms"] is not None else u["start_ms"]), u["text"])
        for u in utterances
        if u is not None and u["text"] is not None and u["start_ms"] is not None
    ]
    names = name_index(billed)
    base = 0 if any(re.match(r"^\W*(?:speaker|s)\s*0\s*:", _CLOCK.sub(" ", c[2]), re.I) for c in cues) else 1
    out: list[list] = []
    current, previous = None, None
    for i in cue_order(cues, kind):
        start, end, text = cues[i]
        who, mark, clean = split_cue(text, names, len(billed), base)
        if not clean:
            continue
        if who is None:
            if current is None:
                who = 0
            elif not mark or len(billed) == 1:
                who = current
            elif len(billed) == 2:
                who = 1 - current
            else:
                who = previous if previous is not None else (current + 1) % len(billed)
        if who != current:
            previous, current = current, who
            out.append([start, end, billed[who].strip(), [clean]])
        else:
            out[-1][1] = max(out[-1][1], end)
            out[-1][3].append(clean)
    return [(a, b, s, " ".join(t)) for a, b, s, t in out]


_TURNS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("turn_no", T.IntegerType()),
        T.StructField("start_ms", T.LongType()),
        T.StructField("end_ms", T.LongType()),
        T.StructField("speaker", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [
            (doc, n, *turn)
            for doc, speakers, cues, kind in zip(pdf["doc_id"], pdf["speakers"], pdf["utterances"], pdf["caption_kind"])
            for n, turn in enumerate(turns(speakers, cues, kind), 1)
        ]
        yield pd.DataFrame(rows, columns=_TURNS.names)


def speaker_turns(transcripts: DataFrame) -> DataFrame:
    """doc_id, turn_no, start_ms, end_ms, speaker, text of every turn; without
    a caption_kind column the kind is unknown."""
    if "caption_kind" not in transcripts.columns:
        transcripts = transcripts.withColumn("caption_kind", F.lit(None).cast("string"))
    return (
        transcripts.where(F.col("doc_id").isNotNull() & (F.size("utterances") > 0))
        .groupBy("doc_id")
        .agg(
            F.max_by(
                F.struct("speakers", "utterances", "caption_kind"),
                F.struct(F.coalesce("version", F.lit(-1)), F.xxhash64("speakers", "utterances", "caption_kind")),
            ).alias("t")
        )
        .select("doc_id", "t.speakers", "t.utterances", "t.caption_kind")
        .mapInPandas(_fold, _TURNS)
    )
