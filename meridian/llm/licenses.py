"""License detection by ordered signature rules.

Some two hundred rules are hand-written signatures (signatures.py): sentences of the licenses' own
texts, headers, titles, short names. More come from a table of license families and a few ways of
naming them (identifier lines, "licensed under", version phrases, addresses). A rule runs only on texts that hold its keyword
(one search for all keywords), but there on the whole text. Detections are taken in the order of
priority, then length, then place; one that lies within an accepted detection is suppressed, so
"GNU Lesser General Public License" is no GPL by a rule. The base phrases are found besides and
are never suppressed.

Null and empty texts have no words and no labels. Rows are scanned each, also if they repeat a
doc_id; a text of any length is scanned whole. Of detections of one priority, length and place
(ties), the label that comes first by name is taken. Other columns are left alone.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text, runs_of, slices
from .pieces import once
from .signatures import KINDS, signatures

#: Base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Family -> keywords (each name has one), names, identifiers and address (patterns).
FAMILIES: dict[str, tuple[str, str, str, str]] = {
    "agpl": ("affero agpl agpl1 agpl2 agpl3 agplv1 agplv2 agplv3", r"(?:gnu )?affero general public licen[cs]e|gnu agpl|agpl(?:-\d[\d.]*(?:-only|-or-later)?)?", r"agpl-[\d.]+(?:-only|-or-later)?", r"gnu\.org/licenses/agpl"),
    "lgpl": ("lesser library lgpl lgpl1 lgpl2 lgpl3 lgplv1 lgplv2 lgplv3", r"(?:gnu )?(?:lesser|library) general public licen[cs]e|gnu lgpl|lgpl(?:-\d[\d.]*(?:-only|-or-later)?)?", r"lgpl-[\d.]+(?:-only|-or-later)?", r"gnu\.org/licenses/lgpl"),
    "gpl": ("gnu gpl gpl1 gpl2 gpl3 gplv1 gplv2 gplv3", r"gnu general public licen[cs]e|gnu gpl|gpl(?:-\d[\d.]*(?:-only|-or-later)?)?", r"gpl-[\d.]+(?:-only|-or-later)?", r"gnu\.org/licenses/gpl"),
    "gfdl": ("documentation fdl", r"gnu free documentation licen[cs]e|gnu fdl", r"gfdl-[\d.]+", r"gnu\.org/licenses/fdl"),
    "apache": ("apache", r"apache (?:software )?licen[cs]e", r"apache-[\d.]+", r"apache\.org/licenses"),
    "mit": ("mit expat", r"mit licen[cs]e|expat licen[cs]e", r"mit", r"opensource\.org/licenses/mit"),
    "bsd-2-clause": ("bsd", r"(?:simplified|2-clause|two-clause) bsd(?: licen[cs]e)?|bsd 2-clause(?: licen[cs]e)?", r"bsd-2-clause", r"opensource\.org/licenses/bsd-2"),
    "bsd-3-clause": ("bsd", r"(?:new|modified|revised|3-clause|three-clause) bsd(?: licen[cs]e)?|bsd 3-clause(?: licen[cs]e)?", r"bsd-3-clause", r"opensource\.org/licenses/bsd-3"),
    "bsd": ("bsd", r"bsd[- ]style licen[cs]e|bsd licen[cs]e", r"bsd", r"opensource\.org/licenses/bsd"),
    "isc": ("isc", r"isc licen[cs]e", r"isc", r"opensource\.org/licenses/isc"),
    "mpl": ("mozilla", r"mozilla public licen[cs]e", r"mpl-[\d.]+", r"mozilla\.org/(?:en-us/)?mpl"),
    "epl": ("eclipse", r"eclipse public licen[cs]e", r"epl-[\d.]+", r"eclipse\.org/legal/epl"),
    "cddl": ("development", r"common development and distribution licen[cs]e", r"cddl-[\d.]+", r"opensource\.org/licenses/cddl"),
    "eupl": ("european", r"european union public licen[cs]e", r"eupl-[\d.]+", r"joinup\.ec\.europa\.eu/[\w/]*eupl"),
    "bsl": ("boost", r"boost software licen[cs]e", r"bsl-[\d.]+", r"boost\.org/license"),
    "artistic": ("artistic", r"artistic licen[cs]e", r"artistic-[\d.]+", r"opensource\.org/licenses/artistic"),
    "zlib": ("zlib", r"zlib(?:/libpng)? licen[cs]e", r"zlib", r"opensource\.org/licenses/zlib"),
    "unlicense": ("unlicense", r"the unlicense", r"unlicense", r"unlicense\.org"),
    "wtfpl": ("wtfpl want", r"do what the \w+ you want to public licen[cs]e|wtfpl", r"wtfpl", r"wtfpl\.net"),
    "python": ("python psf", r"python software foundation licen[cs]e|psf licen[cs]e", r"psf-[\d.]+|python-[\d.]+", r"python\.org/psf/license"),
    "postgresql": ("postgresql", r"postgresql licen[cs]e", r"postgresql", r"postgresql\.org/about/licence"),
    "ofl": ("font", r"sil open font licen[cs]e", r"ofl-[\d.]+", r"scripts\.sil\.org/ofl"),
    "ms-pl": ("microsoft", r"microsoft public licen[cs]e", r"ms-pl", r"opensource\.org/licenses/ms-pl"),
    "odbl": ("database", r"open database licen[cs]e", r"odbl-[\d.]+", r"opendatacommons\.org/licenses/odbl"),
    "pddl": ("dedication", r"public domain dedication and licen[cs]e", r"pddl-[\d.]+", r"opendatacommons\.org/licenses/pddl"),
    "cc0": ("cc0 creative", r"cc0|creative commons zero", r"cc0-[\d.]+", r"creativecommons\.org/publicdomain/zero"),
    "cc-by-nc-sa": ("cc creative", r"cc[- ]by[- ]nc[- ]sa|creative commons attribution[- ]noncommercial[- ]sharealike", r"cc-by-nc-sa-[\d.]+", r"creativecommons\.org/licenses/by-nc-sa"),
    "cc-by-nc-nd": ("cc creative", r"cc[- ]by[- ]nc[- ]nd|creative commons attribution[- ]noncommercial[- ]noderivatives", r"cc-by-nc-nd-[\d.]+", r"creativecommons\.org/licenses/by-nc-nd"),
    "cc-by-nc": ("cc creative", r"cc[- ]by[- ]nc|creative commons attribution[- ]noncommercial", r"cc-by-nc-[\d.]+", r"creativecommons\.org/licenses/by-nc"),
    "cc-by-sa": ("cc creative", r"cc[- ]by[- ]sa|creative commons attribution[- ]sharealike", r"cc-by-sa-[\d.]+", r"creativecommons\.org/licenses/by-sa"),
    "cc-by-nd": ("cc creative", r"cc[- ]by[- ]nd|creative commons attribution[- ]noderivatives", r"cc-by-nd-[\d.]+", r"creativecommons\.org/licenses/by-nd"),
    "cc-by": ("cc creative", r"cc[- ]by|creative commons attribution", r"cc-by-[\d.]+", r"creativecommons\.org/licenses/by"),
    "public-domain": ("domain", r"public domain", r"public-domain", r"creativecommons\.org/publicdomain/mark"),
    "proprietary": ("rights", r"all rights reserved", r"licenseref-proprietary", r"example\.invalid/eula"),
}
#: Ways of naming a license -> priority, confidence and pattern.
WAYS: dict[str, tuple[int, float, str]] = {
    "identifier line": (100, 1.0, r"spdx-license-identifier:? ?(?:{ids})(?![\w.-])"),
    "header field": (90, 0.95, r"licen[cs]e ?[:=] ?(?:{ids}|{names})(?![\w-])"),
    "grant with version": (85, 0.95, r"(?:licen[cs]ed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?(?:{names}),? ?(?:v|ver\.?|version)? ?\d[\d.]*"),
    "grant": (80, 0.9, r"(?:licen[cs]ed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?(?:{names})(?![\w-])"),
    "name with version": (70, 0.8, r"\b(?:{names}),? ?(?:v|ver\.?|version)? ?\d[\d.]*"),
    "notice": (65, 0.8, r"(?:see|under|of) the (?:{names}) for (?:more )?details"),
    "address": (60, 0.75, r"(?:https?://)?(?:www\.)?{url}[\w./-]*"),
    "name": (40, 0.6, r"\b(?:{names})(?![\w-])"),
}
#: What may stand between words of a signature: white space and marks of comments.
GAP, GAP_OR_NONE = r"[\s*#/>]+", r"[\s*#/>]*"
REPORT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


@dataclass(frozen=True)
class Rule:
    label: str
    way: str
    priority: int
    confidence: float
    keywords: tuple[str, ...]
    pattern: re.Pattern


def rules() -> list[Rule]:
    """All rules, in the order in which their detections count."""
    blank = lambda x: x.replace("[- ]", "\1").replace(" ?", "\0").replace(", ", ",? ").replace(" ", GAP)
    gap = lambda x: blank(x).replace("\0", GAP_OR_NONE).replace("\1", f"(?:-|{GAP})").encode()
    edge = lambda x: rb"(?<![\w-])" + x + rb"(?![\w-])"
    out = [Rule(label, kind, *KINDS[kind], (keyword,), re.compile(edge(gap(pattern)))) for label, keyword, kind, pattern in signatures()]
    for label, (keyword, names, ids, url) in FAMILIES.items():
        for way, (priority, confidence, pattern) in WAYS.items():
            keys = tuple(keyword.split())
            if way == "address":
                keys = ("." + url.split("\\.")[1][:3],)
            elif way in ("identifier line", "header field"):  # an identifier need not hold the name's keyword
                keys = ("spdx",) if way == "identifier line" else ("license", "licence")
            filled = pattern.replace("{names}", names).replace("{ids}", ids).replace("{url}", url)
            filled = filled.replace(" ?", r"\s{0,3}").replace("(?:the )", r"(?:the\s+)").replace("[- ]", "\0").replace(" ", r"\s+").replace("\0", "[- ]")
            out.append(Rule(label, way, priority, confidence, keys, re.compile(filled.encode())))
    return sorted(out, key=lambda r: -r.priority)


_WORD = np.ones(256, dtype=bool)
_WORD[:48] = _WORD[58:97] = _WORD[123:128] = False


class Scanner:
    def __init__(self) -> None:
        import ahocorasick

        self.by_key: dict[str, list[Rule]] = {}
        for rule in rules():
            for key in rule.keywords:
                self.by_key.setdefault(key, []).append(rule)
        self.keys = ahocorasick.Automaton()
        for key in self.by_key:
            self.keys.add_word(key, key)
        self.keys.make_automaton()
        gap, word = rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", rb"[0-9a-z\x80-\xff]"
        self.base = [(re.compile(rb"(?<!" + word + rb")" + gap.join(x.encode() for x in p.split()) + rb"(?!" + word + rb")"), label) for p, label in BASE.items()]

    def detections(self, text: bytes) -> list[tuple[int, int, Rule]]:
        """Start, end and rule of what is accepted in a lower-cased text."""
        keys = set()
        for last, key in self.keys.iter(text.decode("latin-1")):
            start, end = last + 1 - len(key), last + 1
            # A keyword is a whole word; those of addresses begin with a full stop and are open behind.
            if key[0] != "." and (start and _WORD[text[start - 1]] or end < len(text) and _WORD[text[end]]):
                continue
            keys.add(key)
        # A rule of several keywords runs once.
        found = [(m.start(), m.end(), rule) for rule in {id(x): x for key in keys for x in self.by_key[key]}.values() for m in rule.pattern.finditer(text)]
        found.sort(key=lambda x: (-x[2].priority, x[0] - x[1], x[0], x[2].label))
        taken: list[tuple[int, int, Rule]] = []
        starts: list[int] = []
        ends: list[int] = []
        for lo, hi, rule in found:
            # Accepted intervals hold no other, so by start they are also sorted by end.
            k = bisect.bisect_right(starts, lo)
            if k and ends[k - 1] >= hi:
                continue
            first = bisect.bisect_left(starts, lo)
            if first < len(starts) and ends[first] <= hi:  # it holds one of a higher priority: that stays, this goes
                continue
            starts.insert(k, lo)
            ends.insert(k, hi)
            taken.append((lo, hi, rule))
        return taken

    def base_places(self, text: bytes) -> list[tuple[int, str]]:
        return [(m.start(), label) for pattern, label in self.base for m in pattern.finditer(text)]



def license_labels(docs: DataFrame) -> DataFrame:
    """The columns of REPORT and detections: label, way, start and end (bytes) of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = once(("license",), Scanner)
        spans = pa.list_(pa.struct([("label", pa.string()), ("way", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), spans]
        for part in slices(batches):
            lower = part.data.copy()
            lower[(lower >= 65) & (lower <= 90)] += 32
            starts, _ = runs_of(_WORD[lower], part.off)
            first = np.searchsorted(starts, part.off)
            text = lower.tobytes()
            rows = []
            for i in range(len(part)):
                one = text[part.off[i] : part.off[i + 1]]
                base = scanner.base_places(one)
                words = np.searchsorted(starts[first[i] : first[i + 1]], np.array([x[0] for x in base], dtype=np.int64) + part.off[i])
                found = scanner.detections(one)
                labels = {x[1] for x in base}
                missed = 1.0
                for _, _, rule in found:
                    missed *= 1 - rule.confidence
                if base:
                    missed *= 0.1
                every = labels | {x[2].label for x in found}
                detail = [{"label": r.label, "way": r.way, "start": a, "end": b} for a, b, r in found]
                ends = (int(words.min()), int(words.max())) if base else (None, None)
                rows.append((len(base), *ends, ",".join(sorted(labels)), ",".join(sorted(every)), 1 - missed, detail))
            columns = [pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), types, strict=True)]
            names = [x.split()[0] for x in REPORT.split(", ")] + ["detections"]
            yield pa.record_batch([part.column("doc_id"), pa.array(np.diff(first)), *columns], names=names)

    return id_and_text(docs).mapInArrow(run, REPORT + ", detections array<struct<label:string,way:string,start:bigint,end:bigint>>")
