"""Memoised parsing with derivatives over token streams.

A grammar is a set of rules in an EBNF of tokens and rule names. What may follow the tokens read so far is a
set of continuations, each a stack of positions in rules. The derivative of such a set by a token is again
such a set; all derivatives are memoised, for single tokens and for whole lines. An empty derivative marks
the failing token; a set without a nullable continuation at the end marks a text that breaks off.
"""

from __future__ import annotations

import re

END_OF_RULE = -1


class Grammar:
    """Rules as text: ``name = expression``; quoted tokens, rule names, ``|``, ``( )``, ``* + ?``; ``!{'a' 'b'} name`` forbids first tokens."""

    def __init__(self, rules: str, start: str) -> None:
        self.nfa: list[list[tuple[object, int]]] = []  # per node: (None | token | (rule, guard), node)
        self.tokens: dict[str, int] = {}
        entry: dict[str, tuple[int, int]] = {}
        for line in re.split(r"\n(?=\w+ =)", rules.strip()):
            name, _, body = line.partition(" = ")
            words = re.findall(r"'[^']+'|!\{[^}]*\}|[\w]+|[|()*+?]", body)
            pos, begin, end = self._choice(words, 0)
            if pos != len(words):
                raise ValueError(f"rule {name}: {words[pos:]}")
            entry[name.strip()] = (begin, end)
        self._determine(entry, start)

    def _node(self) -> int:
        self.nfa.append([])
        return len(self.nfa) - 1

    def _choice(self, w: list[str], i: int) -> tuple[int, int, int]:
        begin, end = self._node(), self._node()
        while True:
            at = self._node()
            self.nfa[begin].append((None, at))
            while i < len(w) and w[i] not in "|)":
                i, a, b = self._part(w, i)
                self.nfa[at].append((None, a))
                at = b
            self.nfa[at].append((None, end))
            if i < len(w) and w[i] == "|":
                i += 1
                continue
            return i, begin, end

    def _part(self, w: list[str], i: int) -> tuple[int, int, int]:
        if w[i] == "(":
            i, a, b = self._choice(w, i + 1)
            i += 1
        else:
            a, b, guard = self._node(), self._node(), frozenset()
            if w[i].startswith("!{"):
                guard = frozenset(x[1:-1] for x in w[i][2:-1].split())
                i += 1
            label: object = w[i][1:-1] if w[i][0] == "'" else (w[i], guard)
            if isinstance(label, str):
                self.tokens.setdefault(label, len(self.tokens))
            self.nfa[a].append((label, b))
            i += 1
        if i < len(w) and w[i] in "*+?":
            x, y = self._node(), self._node()
            self.nfa[x].append((None, a))
            self.nfa[b].append((None, y))
            if w[i] in "*?":
                self.nfa[x].append((None, y))
            if w[i] in "*+":
                self.nfa[b].append((None, a))
            a, b, i = x, y, i + 1
        return i, a, b

    def _determine(self, entry: dict[str, tuple[int, int]], start: str) -> None:
        """Subset construction for each rule, then nullable rules and first tokens."""

        def closure(nodes: frozenset[int]) -> frozenset[int]:
            seen, todo = set(nodes), list(nodes)
            while todo:
                for label, n in self.nfa[todo.pop()]:
                    if label is None and n not in seen:
                        seen.add(n)
                        todo.append(n)
            return frozenset(seen)

        self.by_token: list[dict[str, int]] = []
        self.by_rule: list[list[tuple[str, frozenset[str], int]]] = []
        self.accepts: list[bool] = []
        self.begin: dict[str, int] = {}
        for name, (b, e) in entry.items():
            ids: dict[frozenset[int], int] = {}

            def state(nodes: frozenset[int]) -> int:
                if nodes not in ids:
                    ids[nodes] = len(self.by_token)
                    self.by_token.append({})
                    self.by_rule.append([])
                    self.accepts.append(e in nodes)
                    todo.append(nodes)
                return ids[nodes]

            todo: list[frozenset[int]] = []
            self.begin[name] = state(closure(frozenset([b])))
            while todo:
                nodes = todo.pop()
                moves: dict[object, set[int]] = {}
                for n in nodes:
                    for label, m in self.nfa[n]:
                        if label is not None:
                            moves.setdefault(label, set()).add(m)
                for label, m in moves.items():
                    to = state(closure(frozenset(m)))
                    if isinstance(label, str):
                        self.by_token[ids[nodes]][label] = to
                    else:
                        self.by_rule[ids[nodes]].append((label[0], label[1], to))
        n = len(self.by_token)
        self.nullable, self.first = [False] * n, [set() for _ in range(n)]
        changed = True
        while changed:
            changed = False
            for q in range(n):
                null, first = self.accepts[q], set(self.by_token[q])
                for rule, guard, to in self.by_rule[q]:
                    first |= self.first[self.begin[rule]] - guard
                    if self.nullable[self.begin[rule]]:
                        first |= self.first[to]
                        null |= self.nullable[to]
                if null != self.nullable[q] or first != self.first[q]:
                    self.nullable[q], self.first[q], changed = null, first, True
        self.final = [self.accepts[q] and not self.by_token[q] and not self.by_rule[q] for q in range(n)]
        self.start = start
        self.forget()

    def forget(self) -> None:
        """Drop all memoised derivatives."""
        self.stacks: list[tuple[int, int]] = []  # (state, stack below or -1)
        self.stack_ids: dict[tuple[int, int], int] = {}
        self.sets: list[tuple[int, ...]] = []
        self.set_ids: dict[tuple[int, ...], int] = {}
        self.step_memo: dict[tuple[int, str], tuple[int, ...]] = {}
        self.derive_memo: dict[tuple[int, str], int] = {}
        self.line_memo: dict[tuple[int, tuple[str, ...]], tuple[int, int]] = {}
        self.empty = self._set(())
        self.initial = self._set((self._stack(self.begin[self.start], -1),))

    def _stack(self, state: int, below: int) -> int:
        key = (state, below)
        if key not in self.stack_ids:
            self.stack_ids[key] = len(self.stacks)
            self.stacks.append(key)
        return self.stack_ids[key]

    def _set(self, stacks: tuple[int, ...]) -> int:
        if stacks not in self.set_ids:
            self.set_ids[stacks] = len(self.sets)
            self.sets.append(stacks)
        return self.set_ids[stacks]

    def _step(self, stack: int, token: str) -> tuple[int, ...]:
        memo = self.step_memo.get((stack, token))
        if memo is not None:
            return memo
        q, below = self.stacks[stack]
        out: set[int] = set()
        to = self.by_token[q].get(token)
        if to is not None:
            out.add(self._stack(to, below))
        for rule, guard, to in self.by_rule[q]:
            b = self.begin[rule]
            if token in self.first[b] and token not in guard:
                rest = below if self.final[to] and below >= 0 else self._stack(to, below)
                out.update(self._step(self._stack(b, rest), token))
            if self.nullable[b]:
                out.update(self._step(self._stack(to, below), token))
        if self.accepts[q] and below >= 0:
            out.update(self._step(below, token))
        result = self.step_memo[stack, token] = tuple(out)
        return result

    def derive(self, state: int, token: str) -> int:
        """The derivative of a set of continuations by a token; ``empty`` if nothing can follow."""
        got = self.derive_memo.get((state, token))
        if got is None:
            out: set[int] = set()
            for s in self.sets[state]:
                out.update(self._step(s, token))
            got = self.derive_memo[state, token] = self._set(tuple(sorted(out)))
        return got

    def derive_line(self, state: int, line: tuple[str, ...]) -> tuple[int, int]:
        """(state after the line, -1), or (empty, index of the failing token)."""
        key = (state, line)
        got = self.line_memo.get(key)
        if got is None:
            at, now = -1, state
            for k, token in enumerate(line):
                now = self.derive(now, token)
                if now == self.empty:
                    at = k
                    break
            got = self.line_memo[key] = (now, at)
        return got

    def complete(self, state: int) -> bool:
        """Whether a continuation is nullable: the text may end here."""
        for s in self.sets[state]:
            while s >= 0:
                q, s = self.stacks[s]
                if not self.nullable[q]:
                    break
            else:
                return True
        return False

    def bound_memory(self, limit: int = 300_000) -> None:
        """Start afresh when more derivatives are kept than the limit."""
        if len(self.derive_memo) + len(self.line_memo) + len(self.step_memo) > limit:
            self.forget()
