"""A small evaluator of query trees in plain Python, to compare plans with."""

from __future__ import annotations

import math

from lantern.plans.ast import BoolQuery, MatchAllQuery, PhraseQuery, RangeQuery, TermQuery, WildcardQuery


class Brute:
    def __init__(self, schema, docs: dict[int, dict]):
        self.schema, self.docs = schema, docs
        self.at: dict[tuple, dict[int, list[int]]] = {}
        self.size: dict[tuple, int] = {}
        for i, d in docs.items():
            for name, kind in schema.fields.items():
                value = d.get(name)
                if value is None or kind.kind not in ("text", "keyword"):
                    continue
                if kind.kind == "text":
                    tokens = kind.get_analyzer().analyze(str(value))
                    self.size[name, i] = len(tokens)
                    for t in tokens:
                        self.at.setdefault((name, t.text), {}).setdefault(i, []).append(t.position)
                else:
                    values = value if isinstance(value, list) else [value]
                    self.size[name, i] = len(values)
                    for v in values:
                        if term := str(v).lower().strip():
                            self.at.setdefault((name, term), {}).setdefault(i, []).append(0)

    def score(self, tf, df, name, i):
        n = len(self.docs)
        mean = sum(v for (f, _), v in self.size.items() if f == name) / n
        idf = math.log((n - df + 0.5) / (df + 0.5) + 1)
        return idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * self.size[name, i] / max(mean, 1.0)))

    def term(self, word, name):
        kind = self.schema.get(name)
        if kind is None or kind.kind not in ("text", "keyword"):
            return {}
        term = word if kind.kind == "keyword" else (kind.get_analyzer().first(word) or word)
        got = self.at.get((name, term), {})
        return {i: self.score(len(p), len(got), name, i) * kind.boost for i, p in got.items()}

    def run(self, q) -> dict[int, float]:
        match q:
            case MatchAllQuery():
                return {i: q.boost for i in self.docs}
            case TermQuery():
                out: dict[int, float] = {}
                for f in [q.field] if q.field else self.schema.get_searchable_fields():
                    for i, s in self.term(q.term, f).items():
                        out[i] = out.get(i, 0.0) + s * q.boost
                return out
            case WildcardQuery():
                out, prefix = {}, q.pattern.rstrip("*").lower()
                for f in [q.field] if q.field else self.schema.get_searchable_fields():
                    for name, term in list(self.at):
                        if name == f and term.startswith(prefix):
                            for i, s in self.term(term, f).items():
                                out[i] = max(out.get(i, -1e9), s * q.boost)
                return out
            case PhraseQuery():
                return self.phrase(q)
            case RangeQuery():
                out = {}
                for i, d in self.docs.items():
                    try:
                        v = float(d.get(q.field))
                    except (TypeError, ValueError):
                        continue
                    low = q.gte is not None and v < q.gte or q.gt is not None and v <= q.gt
                    if not (low or q.lte is not None and v > q.lte or q.lt is not None and v >= q.lt):
                        out[i] = q.boost
                return out
            case BoolQuery():
                return self.tree(q)
        return {}

    def phrase(self, q):
        out: dict[int, float] = {}
        for f in [q.field] if q.field else self.schema.get_text_fields():
            kind = self.schema.get(f)
            if kind is None or kind.kind not in ("text", "keyword"):
                continue
            words = [w for w in (kind.get_analyzer().first(t) for t in q.terms) if w]
            lists = [self.at.get((f, w), {}) for w in words]
            for i in set(lists[0]).intersection(*lists[1:]) if lists else ():
                if any(self.chain(start, [x[i] for x in lists[1:]], q.slop) for start in lists[0][i]):
                    out[i] = out.get(i, 0.0) + self.score(1, len(lists[0]), f, i) * kind.boost * q.boost * 2
        return out

    @staticmethod
    def chain(at, rest, slop):
        for own in rest:
            at = next((p for p in sorted(own) if abs(p - at - 1) <= slop), None)
            if at is None:
                return False
        return True

    def tree(self, q):
        must, should = [self.run(x) for x in q.must], [self.run(x) for x in q.should]
        best: dict[int, float] = {}
        for s in should:
            for i, v in s.items():
                best[i] = max(best.get(i, v), v)
        if must:
            ids = set(must[0]).intersection(*must[1:])
            out = {i: sum(m[i] for m in must) + best.get(i, 0.0) for i in ids}
        elif should:
            out = best
        else:
            return {}
        gone = {i for x in q.must_not for i in self.run(x)}
        return {i: v * q.boost for i, v in out.items() if i not in gone}
