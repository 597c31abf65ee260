"""Prediction by partial matching from its definition, one byte at a time, over dictionaries."""

import math
from collections import Counter, defaultdict

MARK = b"\xff"


def step(x):
    return x if x < 8 else 8 + min(int(2 * math.log2(x / 8)), 23)


class Model:
    def __init__(self, texts, order, lean=16):
        self.order, self.lean = order, lean
        strings = Counter()
        for t in texts:
            d = MARK * order + t + MARK
            strings.update(d[i : i + order + 1] for i in range(len(d) - order))
        #: symbols[k][context] -> how often (longest) or after how many different bytes (shorter) each symbol was met
        self.symbols = {order: defaultdict(Counter)}
        for s, n in strings.items():
            self.symbols[order][s[:-1]][s[-1]] = n
        for k in range(order - 1, -1, -1):
            self.symbols[k] = defaultdict(Counter)
            for c, met in self.symbols[k + 1].items():
                for symbol in met:
                    self.symbols[k][c[1:]][symbol] += 1
        self.new, self.known = Counter(), Counter()
        for k in range(2, order + 1):
            for c, met in self.symbols[k].items():
                total, kinds = sum(met.values()), len(met)
                for n in met.values():
                    if n == 1:
                        self.new[k, c[-2:], step(total - 1), step(kinds - 1)] += 1
                    else:
                        self.known[k, c[-2:], step(total - 1), step(kinds)] += n

    def escape(self, c, met):
        total, kinds = sum(met.values()), len(met)
        if len(c) < 2:
            return kinds / 2 / total
        key = (len(c), c[-2:], step(total), step(kinds))
        return (self.new[key] + self.lean * kinds / 2 / total) / (self.new[key] + self.known[key] + self.lean)

    def probability(self, c, symbol):
        met = self.symbols[len(c)].get(c)
        if not c:
            if not met:
                return 1 / 256
            total = sum(met.values())
            return (met[symbol] - 0.5) / total if symbol in met else len(met) / 2 / total / (256 - len(met))
        if not met:
            return self.probability(c[1:], symbol)
        e = self.escape(c, met)
        if symbol in met:
            return (1 - e) * met[symbol] / sum(met.values())
        return e * self.probability(c[1:], symbol) / (1 - sum(self.probability(c[1:], s) for s in met))

    def score(self, t):
        d = MARK * self.order + t + MARK
        return sum(math.log10(self.probability(d[i - self.order : i], d[i])) for i in range(self.order, len(d)))
