import random

import numpy as np
import pytest

from heddle.llm import licenses as L

SCHEMA = "doc_id long, text string, license string"


def brute(text, containment=0.8):
    """Which templates some window of their own length holds, window by window."""
    words, out = L.words_of(text or ""), {}
    for name, t in L.TEMPLATES.items():
        w = L.words_of(t)
        k = min(L.WIDTH, len(w))
        own = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
        got = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
        s = len(w) - k + 1
        best = max((len(own & set(got[i : i + s])) / len(own) for i in range(len(got))), default=0)
        if best >= containment:
            out[name] = best
    return out


def share(span, name):
    """How much of a template a span of text holds."""
    words, w = L.words_of(span), L.words_of(L.TEMPLATES[name])
    k = min(L.WIDTH, len(w))
    of = lambda x: {tuple(x[i : i + k]) for i in range(len(x) - k + 1)}
    return len(of(words) & of(w)) / len(of(w))


def corpus(n=300, seed=8):
    r = random.Random(seed)
    vocab = ["".join(r.choices("abcdeéfg", k=r.randint(1, 7))) for _ in range(300)]
    filler = lambda k: " ".join(r.choices(vocab, k=k))
    rows = []
    for i in range(n):
        text = filler(r.randint(0, 200))
        for name in r.sample(list(L.TEMPLATES), r.choice([0, 0, 1, 2])):
            w = L.TEMPLATES[name].split()
            for _ in range(r.choice([0, 0, 1, 2, 6])):
                w[r.randrange(len(w))] = r.choice(vocab)
            text += r.choice(["\n", " # ", "\n// "]) + r.choice([" ", "\n// "]).join(w).upper() + " " + filler(r.randint(0, 60))
        rows.append((i, text, "mine"))
    return [*rows, (n, None, None), (n + 1, "", "x"), (n + 2, "All rights reserved", "x"), (n + 3, "All rights", "x"), (None, "All rights reserved.", "x")]


def test_against_brute_force(spark, monkeypatch):
    rows = corpus()
    got = {}
    texts = {d: t for d, t, _ in rows}
    for x in L.scan(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(x.doc_id, {}).setdefault(x.license, []).append(x)
    want = {d: b for d, t, _ in rows if (b := brute(t))}
    sure = sum(set(want[d]) <= set(got.get(d, {})) for d in want)  # a match may be wider than the window; its span is held against the template below
    assert sure >= len(want) - 1 and set(got) >= {d for d in want if "rights reserved" in want[d]}
    for d, found in got.items():
        for name, xs in found.items():
            assert max(x.containment for x in xs) >= brute(texts[d]).get(name, 0) - 1e-9 and all(x.containment >= 0.8 for x in xs)
            for x in xs:  # the span holds what was counted
                assert share(texts[d][x.start : x.stop], name) >= x.containment - 1e-9


def test_blocks_do_not_change_matches(monkeypatch):
    texts = [t or "" for _, t, _ in corpus(120)]
    one = [*L.Index(L.TEMPLATES, 0.8, 0.999).found(texts)]
    monkeypatch.setattr(L, "BLOCK", 500)
    assert [*L.Index(L.TEMPLATES, 0.8, 0.999).found(texts)] == one and one


def test_a_match_depends_on_its_text_alone():
    texts = [t or "" for _, t, _ in corpus(400, seed=3)]
    index = L.Index(L.TEMPLATES, 0.8, 0.999)
    together = [*index.found(texts)]
    alone = [(i, *x[1:]) for i, t in enumerate(texts) for x in index.found([t])]
    assert sorted(together) == sorted(alone) and together


@pytest.mark.parametrize("s", [5, 8, 16, 40, 90])
def test_bands_collide_as_promised(s):
    r = np.random.default_rng(s)
    stride = max(1, s // 8) if s >= 16 else 1
    n = L.bands_for(s, stride, 0.8, 0.999)
    index = L.Index({"x": "a"}, 0.8, 0.999)
    miss = 0
    for _ in range(300):
        a = r.integers(0, 1 << 63, s, dtype=np.uint64)
        b = a.copy()
        m = -(-4 * s // 5)
        b[r.permutation(s)[: s - m]] = r.integers(0, 1 << 63, s - m, dtype=np.uint64)
        b = np.concatenate([b[stride // 2 :], r.integers(0, 1 << 63, stride // 2, dtype=np.uint64)])
        miss += not any(x[0][0] == y[0][0] for x, y in zip(*(index.bands(v, n, lambda p: {0: L.least_of(L.doubled(p, s), np.array([0]), s)}) for v in (a, b))))
    assert miss <= 3


def test_empty_table(spark):
    assert L.scan(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        L.scan(spark.createDataFrame([], SCHEMA), {"none": "--"})


def test_licenses_of_a_family_are_told_apart(spark, tmp_path):
    from heddle.llm import queries

    gnu = lambda what, v: f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {what}General Public License as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {what}General Public License for more details."
    bsd = L.TEMPLATES["BSD-2-Clause"]
    third = " 3. Neither the name of Example Corp nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    texts = {"GPL-2.0": gnu("", 2), "GPL-3.0": gnu("", 3), "LGPL-3.0": gnu("Lesser ", 3), "AGPL-3.0": gnu("Affero ", 3), "LGPL-2.1": L.TEMPLATES["LGPL-2.1"], "BSD-2-Clause": bsd, "BSD-3-Clause": bsd + third}
    tail = {"GPL-2.0": " You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."}
    for name, what in (("LGPL-3.0", "Lesser "), ("AGPL-3.0", "Affero "), ("GPL-3.0", "")):
        tail[name] = f" You should have received a copy of the GNU {what}General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
    rows = [(i, "some words before\n" + t + tail.get(name, ""), "x") for i, (name, t) in enumerate(texts.items())]
    rows += [(100 + i, t, "x") for i, t in enumerate(texts.values())]  # without the last sentence
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((x.doc_id, x.license) for x in queries.op4_licenses(spark, str(tmp_path)).collect())
    names = [*texts]
    assert got == [*enumerate(names)] + [(100 + i, n) for i, n in enumerate(names)]


def test_whole_texts_are_named_as_such(spark):
    whole = [n for n in L.TEMPLATES if n.endswith(" text")]
    rows = [(i, "Copyright 2020 Some One\n\n" + L.TEMPLATES[n].replace(". ", ".\n"), "x") for i, n in enumerate(whole)]
    got = sorted((x.doc_id, x.license) for x in L.scan(spark.createDataFrame(rows, SCHEMA), best=True).collect())
    assert got == [*enumerate(whole)] and len(whole) == 8
