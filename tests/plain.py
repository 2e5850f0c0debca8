"""Straightforward Python versions for small fixtures."""

from __future__ import annotations

import math
import random

from ampliq.constants import NN_DH, NN_DS

COMP = str.maketrans("ACGTN", "TGCAN")
LN_NA = math.log((50 + 120 * math.sqrt(0.9)) / 1000)


def rc(s: str) -> str:
    return s.translate(COMP)[::-1]


def dna(n: int, seed: int) -> str:
    return "".join(random.Random(seed).choices("ACGT", k=n))


def hits(oligos, contigs, word=8, identity=80.0):
    out = set()
    for oligo in set(oligos):
        for strand, text in (("+", oligo), ("-", rc(oligo))):
            n = len(text)
            for chrom, seq in contigs:
                for start in range(len(seq) - n + 1):
                    here = seq[start:start + n]
                    same = [a == b and a in "ACGT" for a, b in zip(text, here)]
                    if any(all(same[i:i + word]) for i in range(n - word + 1)) and 100.0 * sum(same) / n >= identity:
                        out.add((oligo, strand, chrom, start + 1, 100.0 * sum(same) / n, here if strand == "+" else rc(here)))
    return out


def stem(x: str, y: str, kind: str):
    """Least (dG, k, i) with its dH, entropy and length, or None."""
    yr, best = rc(y), None
    n = len(x)
    for k in range(1 - len(y), n):
        run = []
        for i in range(1, n + 2):
            ok = i <= n and 1 <= i - k <= len(y) and x[i - 1] == yr[i - k - 1] and x[i - 1] in "ACGT"
            if kind == "hairpin" and 2 * i > n + k - 3:
                ok = False
            if ok:
                run.append(i)
                continue
            if len(run) >= 2:
                s = x[run[0] - 1:run[-1]]
                dh = sum(NN_DH[s[j:j + 2]] for j in range(len(s) - 1))
                ds = sum(NN_DS[s[j:j + 2]] for j in range(len(s) - 1))
                if kind != "hairpin":
                    for end in (s[0], s[-1]):
                        dh += 23 if end in "AT" else 1
                        ds += 41 if end in "AT" else -28
                e = ds / 10 + 0.368 * (len(s) - 1) * LN_NA - (11.3 if kind == "hairpin" else 0)
                dg = dh / 10 - 310.15 * e / 1000
                key = (math.floor(dg * 1e6 + 0.5), k, run[0])
                if best is None or key < best[0]:
                    best = (key, dg, dh / 10, e, len(s))
            run = []
    return best


def melting(s: str) -> float:
    dh = sum(NN_DH[s[j:j + 2]] for j in range(len(s) - 1))
    ds = sum(NN_DS[s[j:j + 2]] for j in range(len(s) - 1))
    for end in (s[0], s[-1]):
        dh += 23 if end in "AT" else 1
        ds += 41 if end in "AT" else -28
    c = 50e-9
    if s == rc(s):
        ds -= 14
    else:
        c /= 4
    return dh * 100 / (ds / 10 + 0.368 * (len(s) - 1) * LN_NA + 1.987 * math.log(c)) - 273.15
