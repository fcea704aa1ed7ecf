import random
import re

import numpy as np

from tidemark.llm import license_scan as ls


def grams(text, k):
    w = re.findall(r"[A-Za-z0-9\u0080-\U0010ffff]+", text or "")
    w = [x.lower() if x.isascii() else x for x in w]
    return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]


def test_scan_matches_brute_force(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(5))
    text = lambda n: [word() for _ in range(n)]
    rows = []
    for i in range(200):
        w = text(r.randrange(0, 200))
        for name in r.sample(list(ls.TEMPLATES), r.randrange(0, 3)):
            t = ls.TEMPLATES[name].split()
            if r.random() < 0.3:
                t[-1] = word()
            at = r.randrange(len(w) + 1)
            w[at:at] = t
        rows.append((i, " ".join(w) if r.random() < 0.5 else "\n".join(w).upper()))
    rows += [(300, None), (301, ""), (302, "All rights"), (303, "All rights reserved"), (304, "  ALL\nrights, reserved!! "), (303, "All rights reserved"), (None, ls.TEMPLATES["GPL-3.0"]), (305, "x " * 50000 + ls.TEMPLATES["MIT"])]
    docs = spark.createDataFrame([(k, t, "w") for k, t in rows], "doc_id long, text string, windows string")
    got = sorted(((x.doc_id, x.license_id) for x in ls.scan(docs).collect()), key=str)
    want, of = [], {n: t for t in ls.tiers(ls.TEMPLATES) for n in t.templates}
    for key, t in rows:
        for name, template in ls.TEMPLATES.items():
            n = len(grams(template, 1))
            k = min(5, n)
            need = set(grams(template, k))
            held = grams(t, k)
            if any(len(need & set(held[i : i + of[name].window])) >= 0.8 * len(need) for i in range(0, max(1, len(held)), of[name].step)):
                want.append((key, name))
    assert got == sorted(want, key=str)


def test_every_pair_that_would_be_accepted_shares_a_band():
    """The worst case: a tier's shortest template, 0.8 of it in a window of the tier's full length."""
    r, missed, tried = np.random.default_rng(1), 0, 0
    for longest in (5, 20, 60, 150):
        shortest = int(np.ceil(longest / ls.WIDTH))
        for _ in range(1500):
            template = r.integers(0, 1 << 62, shortest).astype(np.uint64)
            tier = ls.Tier(5, {"t": template, "longest": r.integers(0, 1 << 62, longest).astype(np.uint64)})
            kept = template[: int(np.ceil(ls.SIMILAR * shortest))]
            window = np.concatenate([kept, r.integers(0, 1 << 62, tier.window - len(kept)).astype(np.uint64)])
            missed += not any(ls._signature(window, b).min() == tier.bands[b]["t"] for b in range(ls.BANDS))
            tried += 1
    assert missed <= 0.001 * tried


def test_windows_are_as_wide_as_they_say():
    r = np.random.default_rng(2)
    for longest in range(1, 400):
        tier = ls.Tier(5, {"t": np.arange(longest, dtype=np.uint64)})
        assert longest + tier.step - 1 <= tier.window <= max(longest + 1, 1.25 * longest) and tier.window % tier.step == 0
    for longest in (1, 7, 36, 42, 150):
        tier = ls.Tier(5, {"t": np.arange(longest, dtype=np.uint64)})
        first = np.array([0, 130, 130, 500])
        h = r.integers(0, 1 << 62, 500).astype(np.uint64)
        starts, same = tier.blocks(first)
        got = tier.windows(h, starts, same)
        for s, least in zip(starts, got, strict=True):
            end = first[np.searchsorted(first, s, "right")]
            assert least == h[s : min(end, s + tier.window)].min()


def test_tiers_are_narrow_and_hold_every_template():
    held = ls.tiers(ls.TEMPLATES)
    assert sorted(n for t in held for n in t.templates) == sorted(ls.TEMPLATES)
    assert all(max(map(len, t.templates.values())) <= ls.WIDTH * min(map(len, t.templates.values())) for t in held)


def test_scan_of_nothing(spark):
    assert ls.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
