"""URL filters by a bit-parallel wildcard automaton.

Rules are globs on host and path: ``*`` stands for any run of characters (inside a host: of one without a slash), ``?``
for one character. A rule fits its host and all subdomains where the path starts with the rule's path. Of the rules that
fit a URL the longest wins (host and path together; of equally long ones a blocking rule, then the least text); where
none fits, the verdict is a parameter.

All rules are packed into the bits of multiword Shift-And masks. A rule is a run of states: its start, then one state
per literal or ``?``; a ``*`` lets the state before it stay on any character of its kind. One step takes a character of
every URL of a batch and moves all states of all rules at once: ``(D << 1) & step[c] | D & stay[c]``. The text is
``.`` + host + path, so that a rule for ``a.org`` is the pattern ``*.a.org`` up to the first slash. A URL is done when
it ends, when no state is left, or when all states left are accepting ones that stay for ever; so long tails of paths
and queries cost nothing.

The rules are a short list of the caller's: their masks are limited to ``MAX_MASK_BYTES`` (some 1.6 million characters
of rules over 40 different ones) and go to the tasks with the function; a longer list raises ValueError. URLs are judged
where they are read, without any shuffle.

Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased. Path: what follows it,
up to ``?``, ``#`` or the end. Defined cases: null, empty and other URLs without ``://`` have an empty host and path and
get the verdict for no rule unless a rule fits the empty host; repeated rows are judged one by one; an empty table gives
an empty table; an empty list of rules fits nothing; columns named like the new ones are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_MASK_BYTES = 16 << 20
#: Bytes of the states of one batch of URLs.
STATE_BYTES = 8 << 20
VERDICTS = ("allow", "block")
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


def url_host(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _UPPER.lower())


def url_path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


class Automaton:
    """The masks of a list of rules."""

    def __init__(self, rules: list[Rule]):
        for rule in rules:
            if rule.verdict not in VERDICTS:
                raise ValueError(f"verdict {rule.verdict!r} is neither allow nor block")
        # The best rule first, so the first one that accepts wins.
        order = sorted(rules, key=lambda r: (-len(r.text), r.verdict != "block", r.text))
        self.rules = order
        literals = sorted({c for r in order for c in r.text.replace("*", "").replace("?", "")} | {"/", "."})
        # Class 0 is every other character.
        self.codes = np.array([ord(c) for c in literals], dtype=np.uint32)
        self.classes = len(literals) + 1
        slash = literals.index("/") + 1
        # (classes a state is entered by, classes it stays on) of each state; None: all classes.
        states: list[tuple[list[int] | None, list[int] | None]] = []
        no_slash = [c for c in range(self.classes) if c != slash]
        starts, ends = [], []
        for rule in order:
            starts.append(len(states))
            # In front of the host may stand further labels.
            states.append(([], no_slash))
            for part, any_run in ((f".{rule.host}", no_slash), (f"{rule.path}*", None)):
                for c in part:
                    if c == "*":
                        states[-1] = (states[-1][0], any_run)
                    elif c == "?":
                        states.append((any_run, []))
                    else:
                        states.append(([literals.index(c) + 1], []))
            ends.append(len(states) - 1)
        self.words = max(1, -(-len(states) // 64))
        if 2 * self.classes * self.words * 8 > MAX_MASK_BYTES:
            raise ValueError(f"the masks of {len(rules)} rules take more than {MAX_MASK_BYTES} bytes")
        self.step = np.zeros((self.classes, self.words), dtype=np.uint64)
        self.stay = np.zeros((self.classes, self.words), dtype=np.uint64)
        for place, (entered, stays) in enumerate(states):
            bit = np.uint64(1) << np.uint64(place % 64)
            for table, of in ((self.step, entered), (self.stay, stays)):
                table[slice(None) if of is None else of, place // 64] |= bit
        self.start = self._bits(starts)
        self.ends = np.array(ends, dtype=np.int64)
        # Accepting states that stay on every character.
        self.settled = np.bitwise_and.reduce(self.stay, axis=0) & self._bits(ends)

    def _bits(self, places: list[int]) -> np.ndarray:
        out = np.zeros(self.words, dtype=np.uint64)
        for p in places:
            out[p // 64] |= np.uint64(1) << np.uint64(p % 64)
        return out

    def _classes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Character classes of all texts behind each other, and where each text starts."""
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        at = np.searchsorted(self.codes, points).clip(max=len(self.codes) - 1)
        found = np.where(self.codes[at] == points, at + 1, 0).astype(np.int32)
        return found, np.cumsum([0, *map(len, texts)])

    def _run(self, texts: list[str]) -> np.ndarray:
        """Index of the winning rule of each text, -1 for none."""
        classes, starts = self._classes(texts)
        lengths = np.diff(starts)
        final = np.zeros((len(texts), self.words), dtype=np.uint64)
        live = np.arange(len(texts))
        state = np.broadcast_to(self.start, (len(texts), self.words)).copy()
        step = 0
        while live.size:
            over = lengths[live] <= step
            # Now and then, rows whose states can't change any more leave too.
            if step % 8 == 0:
                over |= ~(state & ~self.settled).any(axis=1)
            if over.any():
                final[live[over]] = state[over]
                live, state = live[~over], state[~over]
                if not live.size:
                    break
            c = classes[starts[live] + step]
            moved = state << np.uint64(1)
            moved[:, 1:] |= state[:, :-1] >> np.uint64(63)
            state = (moved & self.step[c]) | (state & self.stay[c])
            step += 1
        if not self.rules:
            return np.full(len(texts), -1)
        accepted = (final[:, self.ends // 64] >> (self.ends % 64).astype(np.uint64)) & np.uint64(1)
        return np.where(accepted.any(axis=1), accepted.argmax(axis=1), -1)

    def winners(self, texts: list[str]) -> np.ndarray:
        rows = max(1, STATE_BYTES // (8 * self.words + len(self.ends) + 1))
        parts = [self._run(texts[i : i + rows]) for i in range(0, len(texts), rows)]
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)


def judge_urls(pages: DataFrame, rules: list[Rule], url: str = "url", unmatched: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (host and path of the winning rule, else null) and ``verdict``."""
    if unmatched not in VERDICTS:
        raise ValueError(f"verdict {unmatched!r} is neither allow nor block")
    automaton = Automaton(rules)
    told = np.array([r.text for r in automaton.rules] + [None], dtype=object)
    verdicts = np.array([r.verdict for r in automaton.rules] + [unmatched], dtype=object)

    @F.pandas_udf("rule string, verdict string")
    def judged(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        at = automaton.winners(("." + host + path).tolist())
        return pd.DataFrame({"rule": told[at], "verdict": verdicts[at]})

    names = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    kept = [F.col(f"`{c}`") for c in names]
    # The row travels as one struct, so that no other column can clash with the fields added here.
    parts = pages.select(
        F.struct(*kept).alias("row"), url_host(F.col(f"`{url}`")).alias("host"), url_path(F.col(f"`{url}`")).alias("path")
    )
    return parts.withColumn("judged", judged("host", "path")).select(
        "row.*", "host", "path", F.col("judged.rule").alias("rule"), F.col("judged.verdict").alias("verdict")
    )
