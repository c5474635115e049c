"""A lexicon trie, and Levenshtein automata that are run over it."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Node:
    """``whole`` and ``stem``: the term that is complete here as a word, or as the beginning of words."""

    children: dict[str, Node] = field(default_factory=dict)
    whole: int = -1
    stem: int = -1


class Lexicon:
    """Terms: letters, whether it is a stem that any ending may follow, and whether it may be misspelt.

    ``match`` intersects the automaton of all words within one edit of the given word with the trie: it walks both
    together and leaves a branch as soon as the automaton is stuck. Terms shorter than ``fuzzy_from`` match exactly, too.
    """

    def __init__(self, terms: list[tuple[str, bool, bool]], fuzzy_from: int = 5):
        self.terms, self.fuzzy_from, self.root = terms, fuzzy_from, Node()
        for i, (term, stem, _) in enumerate(terms):
            node = self.root
            for c in term:
                node = node.children.setdefault(c, Node())
            if stem:
                node.stem = i
            else:
                node.whole = i

    def match(self, word: str) -> tuple[int, int] | None:
        """The term nearest to ``word`` and its distance (0 or 1), or None. Exact matches go before others, early terms before later."""
        places: dict[str, int] = {}
        for i, c in enumerate(word):
            places[c] = places.get(c, 0) | 1 << i
        end = 1 << len(word)
        best: tuple[int, int] | None = None
        # Bit i of the states: the first i letters of the word are read, with no edit or with at most one.
        todo = [(self.root, 1, 3)]
        while todo:
            node, exact, near = todo.pop()
            for term, no_edit, one_edit in ((node.whole, exact & end, near & end), (node.stem, exact, near)):
                if term >= 0 and (no_edit or (one_edit and self.terms[term][2] and len(self.terms[term][0]) >= self.fuzzy_from)):
                    found = (0 if no_edit else 1, term)
                    best = found if best is None or found < best else best
            for c, child in node.children.items():
                hit = places.get(c, 0)
                to = (exact & hit) << 1
                # A letter of the term that agrees, is missing in the word, or is replaced; or an extra letter of the word.
                one = ((near & hit) << 1) | exact | (exact << 1) | (to << 1)
                one &= (end << 1) - 1
                if to or one:
                    todo.append((child, to, one))
        return None if best is None else (best[1], best[0])
