"""Plain restatements of the search rules, one search and one item at a time."""

from __future__ import annotations

import re

from evidex.operators.postings import STOP_WORDS
from evidex.vocabulary import FIELD_WEIGHTS

VOWELS = "aeiou"


def tokens(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def _kinds(word):
    out = ""
    for k, ch in enumerate(word):
        out += "v" if ch in VOWELS or ch == "y" and k > 0 and out[-1] == "c" else "c"
    return out


def measure(word):
    return len(re.findall("vc", re.sub(r"(.)\1+", r"\1", _kinds(word))))


def stem(word):
    """Step 1 of Porter's algorithm as his paper words it."""
    if len(word) <= 2:
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    cut = None
    if word.endswith("eed"):
        word = word[:-1] if measure(word[:-3]) > 0 else word
    elif word.endswith("ed") and "v" in _kinds(word[:-2]):
        cut = word[:-2]
    elif word.endswith("ing") and "v" in _kinds(word[:-3]):
        cut = word[:-3]
    if cut is not None:
        word = cut
        kinds = _kinds(word)
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif len(word) > 1 and word[-1] == word[-2] and kinds.endswith("cc") and word[-1] not in "lsz":
            word = word[:-1]
        elif measure(word) == 1 and kinds.endswith("cvc") and word[-1] not in "wxy":
            word += "e"
    if word.endswith("y") and "v" in _kinds(word[:-1]):
        word = word[:-1] + "i"
    return word


def occurrences(fields):
    """[(term, weight)] by place; fields follow one another."""
    return [(None if t in STOP_WORDS else stem(t), w) for text, w in fields for t in tokens(text)]


def item_fields(item):
    return [(f"{item['code']} {item['name']}", FIELD_WEIGHTS["A"]), (" ".join(item["terms"] or []), FIELD_WEIGHTS["B"]), (item["description"], FIELD_WEIGHTS["C"])]


def alternatives(text):
    """[[(negated, [(offset, term)])]] of a search text."""
    out = [[]]
    for unit in re.findall(r'-?"[^"]*"|\S+', (text or "").strip().lower()):
        if unit == "or":
            out.append([])
            continue
        terms = [(k, stem(t)) for k, t in enumerate(tokens(unit)) if t not in STOP_WORDS]
        if terms:
            out[-1].append((unit.startswith("-"), terms))
    return [a for a in out if a]


def holds(unit, at):
    return any(all(0 <= s + k < len(at) and at[s + k][0] == t for k, t in unit) for s in range(-len(at), len(at)))


def cover_rank(words, at):
    """Minimal spans that hold all words; each scores by its width and the harmonic mean of the weights at its last places."""
    score = 0.0
    spans = [(s, e) for e in range(len(at)) for s in range(e + 1) if words <= {t for t, _ in at[s:e + 1]}]
    for s, e in spans:
        if not any((a, b) != (s, e) and s <= a and b <= e for a, b in spans):
            last = [max(k for k in range(s, e + 1) if at[k][0] == w) for w in words]
            score += min(1.0, len(words) / (e - s + 1)) * len(words) / sum(1 / at[k][1] for k in last)
    return round(score, 6)


def text_rank(text, item):
    """The best rank over the alternatives that the item satisfies, else None."""
    at, best = occurrences(item_fields(item)), None
    for units in alternatives(text):
        wanted, barred = [u for n, u in units if not n], [u for n, u in units if n]
        if all(holds(u, at) for u in wanted) and not any(holds(u, at) for u in barred):
            rank = cover_rank({t for u in wanted for _, t in u}, at) if wanted else 0.0
            best = rank if best is None else max(best, rank)
    return best


def grams(text):
    return {f"  {w} "[k:k + 3] for w in tokens(text) for k in range(len(w) + 1)}


def similarity(a, b):
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y) if x | y else 0.0


def passes(search, item, makers, clays):
    def listed(values, value):
        return not values or value in values

    low, high = search["lo"], search["hi"]
    meets = low is None and high is None or (item["lo"] or 1) <= (high if high is not None else 32767) and (32767 if item["hi"] is None else item["hi"]) >= (low if low is not None else 1)
    named = search["codes"] is None or any(c is not None and m is not None and c.strip().lower() == item["code"].lower() and m.strip().lower() == makers[item["maker_id"]]
                                           for c, m in zip(search["codes"], search["code_makers"] or [], strict=False))
    return (listed(search["makers"], item["maker_id"]) and listed(search["lines"], item["line"]) and listed(search["surfaces"], item["surface"]) and listed(search["opacities"], item["opacity"])
            and (search["flag"] is None or item["flag"] == search["flag"]) and meets and named and (not search["clays"] or clays.get(item["item_id"], set()) & set(search["clays"])))


def page(search, items, makers, clays):
    """[(item_id, tier, rank)] of one search's page."""
    rows, text = [], (search["text"] or "").strip()
    for item in items:
        if not passes(search, item, makers, clays):
            continue
        if not text:
            rows.append((0, -1.0, item["code"], item["item_id"], "match"))
            continue
        rank, near, code = text_rank(text, item), similarity(text, item["name"]), similarity(text, item["code"])
        if rank is None and near <= 0.25 and code <= 0.30:
            continue
        match = rank is not None and rank >= 0.02
        rows.append((0 if match else 1, -round(max(rank or 0.0, near, code), 6), item["code"], item["item_id"], "match" if match else "near"))
    low = max(0, search["page_offset"])
    return [(r[3], r[4], -r[1]) for r in sorted(rows)[low:low + max(0, search["page_limit"])]]
