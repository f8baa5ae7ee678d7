"""Filter audit against a loop over documents and orders."""

import random
import re
from itertools import permutations

from varloom.llm.filter_audit import filter_audit


def brute_force(docs, labels):
    """Rows as (part, order, step) -> metrics, document by document."""
    said = {}
    for key, quality, toxic in labels:
        good, bad = said.get(key, (False, False))
        said[key] = (good or quality == 1, bad or toxic == 1)
    judged = []
    for key, text, lang in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        copies = [k for k, other, _ in docs if (other or "") == t and k is not None]
        fails = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)),
            "E": bool(copies) if key is None else min(copies) < key,
        }
        good, toxic = said.get(key, (False, False)) if key is not None else (False, False)
        judged.append((lang or "", {f for f, x in fails.items() if x}, good, toxic))
    out, shapley = {}, {}
    for part in {j[0] for j in judged}:
        mine = [j[1:] for j in judged if j[0] == part]
        for order in map("".join, permutations("ABCDE")):
            for step in range(1, 6):
                f, earlier = order[step - 1], set(order[: step - 1])
                here = [m for m in mine if f in m[0] and not m[0] & earlier]
                kept = sum(1 for m in mine if not m[0] & set(order[:step]))
                out[part, order, step] = [kept, len(here), sum(1 for m in mine if f in m[0] and m[0] & earlier), sum(1 for m in mine if m[0] == {f}), sum(m[1] for m in here), sum(m[2] for m in here)]
                shapley[part, f] = shapley.get((part, f), 0) + len(here)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


NAMES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audited(spark, docs, labels, schema="doc_id long, text string, lang string"):
    rows = filter_audit(spark.createDataFrame(docs, schema), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(rows) == len({(r["part"], r["filter_order"], r["step"]) for r in rows})
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in NAMES) for r in rows}


def test_against_brute_force(spark):
    rng = random.Random(4)
    word = lambda: rng.choice(["ab", "Cd", "EF", "gh#", "é"]) + str(rng.randint(0, 150))
    texts = [" ".join(word() for _ in range(rng.choice([0, 3, 99, 100, 101, 130]))) for _ in range(25)] + ["", None, "a\x0bb", "ABCDEFGHIJ" * 30, "\x1f \x0c", "word " * 20_000]
    docs = [(k if k != 17 else None, rng.choice(texts), rng.choice(["en", "de", None, ""])) for k in range(160)]
    docs += [(3, docs[3][1], "fr"), (3, docs[3][1], "en"), (None, docs[2][1], "de"), docs[5]]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 150, 2)] + [(4, 1, 0), (4, 0, 1), (9999, 1, 1), (None, 1, 1)]
    assert audited(spark, docs, labels) == brute_force(docs, labels)


def test_empty_extra_columns_and_ties(spark):
    assert audited(spark, [], []) == {}
    schema = "doc_id long, text string, lang string, mask int, n long, h string, good boolean, id int, part string, quality int"
    docs = [(1, "x", "en", 1, 2, "h", True, 3, "p", 0), (2, "x", "en", None, None, None, None, None, None, None)]
    assert audited(spark, docs, [(1, 1, 1)], schema) == brute_force([d[:3] for d in docs], [(1, 1, 1)])
