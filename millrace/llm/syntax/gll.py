"""A generalised LL recogniser with a graph-structured stack.

Rules are regular expressions over terminals and rule names; each becomes a deterministic automaton (a recursive
transition network). A descriptor is an automaton state with a stack node. A node stands for one rule called at one
token; its edges are the callers, so all descriptors that called the rule there share one run of it. All descriptors
advance token by token, which keeps several dialects, started together, in step. Sets of possible first and following
tokens are used to drop descriptors that cannot go on; they never drop one that can. Stacks are immutable and
interned, so equal ones are one object across files, and each move of a set of descriptors is worked out once.

Notation, one rule a line, `name = body`: juxtaposition, `|`, `( )`, `[ ]` optional, `*`, `+`, 'text' for a token of
that text, CAPITALS for a class of tokens, lower case for rules, and zero-width tests of the next token: `@asi` (it
stands on a new line, closes a block or ends the file) and `@expr` (it does not begin a block, function or class).
"""

from __future__ import annotations

import re

EOF = "<eof>"
ACCEPTED, REJECTED = -1, -2
#: Sets of descriptors that a worker remembers between files; a bound of memory, without effect on any result.
MOST_CONFIGS = 200_000
_PIECE = re.compile(r"'((?:[^'\\]|\\.)+)'|(@?[A-Za-z_][\w~^]*)|([()|*+\[\]])|\s+")
_ASI_STOP = ("}", EOF)
_NOT_EXPR = ("{", "function", "class")


class _Nfa:
    def __init__(self):
        self.eps: list[list[int]] = []
        self.arcs: list[list[tuple]] = []

    def new(self) -> int:
        self.eps.append([])
        self.arcs.append([])
        return len(self.eps) - 1


def _parse_rule(text: str, nfa: _Nfa) -> tuple[int, int]:
    tokens = []
    for m in _PIECE.finditer(text):
        if m[1] is not None:
            tokens.append(("t", m[1].replace("\\'", "'").replace("\\\\", "\\")))
        elif m[2] is not None:
            tokens.append(("@" if m[2][0] == "@" else "t" if m[2].isupper() else "n", m[2]))
        elif m[3] is not None:
            tokens.append(("x", m[3]))
    at = 0

    def choice():
        nonlocal at
        a, z = nfa.new(), nfa.new()
        while True:
            s, e = sequence()
            nfa.eps[a].append(s)
            nfa.eps[e].append(z)
            if at < len(tokens) and tokens[at] == ("x", "|"):
                at += 1
                continue
            return a, z

    def sequence():
        nonlocal at
        a = z = nfa.new()
        while at < len(tokens) and tokens[at] not in (("x", "|"), ("x", ")"), ("x", "]")):
            kind, v = tokens[at]
            at += 1
            if kind == "x":
                s, e = choice()
                at += 1
                if v == "[":
                    nfa.eps[s].append(e)
            else:
                s, e = nfa.new(), nfa.new()
                nfa.arcs[s].append(((kind, v), e))
            if at < len(tokens) and tokens[at][0] == "x" and tokens[at][1] in "*+":
                star = tokens[at][1] == "*"
                at += 1
                a2, z2 = nfa.new(), nfa.new()
                nfa.eps[a2].append(s)
                nfa.eps[e] += [s, z2]
                if star:
                    nfa.eps[a2].append(z2)
                s, e = a2, z2
            nfa.eps[z].append(s)
            z = e
        return a, z

    return choice()


class Grammar:
    """Automata of all rules, with nullable, first and following sets."""

    def __init__(self, rules: str, starts: list[str]):
        bodies: dict[str, str] = {}
        for line in rules.strip().splitlines():
            name, _, body = line.partition(" = ")
            if not _:
                continue
            name = name.strip()
            bodies[name] = f"{bodies[name]} | {body}" if name in bodies else body
        self.names = list(bodies)
        self.shift: list[dict[str, int]] = []
        self.calls: list[list[tuple[str, int]]] = []
        self.tests: list[list[tuple[str, int]]] = []
        self.final: list[bool] = []
        self.owner: list[str] = []
        self.start: dict[str, int] = {}
        for name, body in bodies.items():
            self._automaton(name, body)
        for calls in self.calls:
            for n, _ in calls:
                if n not in self.start:
                    raise KeyError(f"rule {n} is used but not defined")
        self.starts = starts
        self._sets()
        self._actions: dict = {}
        self._reset()

    def _automaton(self, name, body):
        nfa = _Nfa()
        a, z = _parse_rule(body, nfa)

        def closure(states):
            todo, seen = list(states), set(states)
            while todo:
                for e in nfa.eps[todo.pop()]:
                    if e not in seen:
                        seen.add(e)
                        todo.append(e)
            return frozenset(seen)

        ids: dict = {}
        todo = []

        def state(s):
            if s not in ids:
                ids[s] = len(self.final)
                self.shift.append({})
                self.calls.append([])
                self.tests.append([])
                self.final.append(z in s)
                self.owner.append(name)
                todo.append(s)
            return ids[s]

        self.start[name] = state(closure([a]))
        while todo:
            s = todo.pop()
            arcs: dict = {}
            for x in s:
                for label, e in nfa.arcs[x]:
                    arcs.setdefault(label, set()).add(e)
            k = ids[s]
            for (kind, v), es in arcs.items():
                e = state(closure(es))
                if kind == "t":
                    self.shift[k][v] = e
                else:
                    (self.calls if kind == "n" else self.tests)[k].append((v, e))

    def _sets(self):
        n = len(self.final)
        null = [self.final[i] for i in range(n)]
        first: list[set] = [set(self.shift[i]) for i in range(n)]
        changed = True
        while changed:
            changed = False
            for i in range(n):
                size, was = len(first[i]), null[i]
                for r, e in self.calls[i]:
                    s = self.start[r]
                    first[i] |= first[s]
                    if null[s]:
                        first[i] |= first[e]
                        null[i] = null[i] or null[e]
                for _, e in self.tests[i]:
                    first[i] |= first[e]
                    null[i] = null[i] or null[e]
                changed = changed or len(first[i]) != size or null[i] != was
        follow: dict[str, set] = {r: set() for r in self.start}
        for s in self.starts:
            follow[s].add(EOF)
        changed = True
        while changed:
            changed = False
            for i in range(n):
                for r, e in self.calls[i]:
                    size = len(follow[r])
                    follow[r] |= first[e]
                    if null[e]:
                        follow[r] |= follow[self.owner[i]]
                    changed = changed or len(follow[r]) != size
        self.null, self.first, self.follow = null, first, follow

    def action(self, state: int, kinds: tuple, fresh: bool):
        """(shifts, calls, jumps, pop) of a state before a token of these kinds, fresh if on a new line."""
        shifts = [self.shift[state][k] for k in kinds if k in self.shift[state]]
        calls = []
        for r, e in self.calls[state]:
            s = self.start[r]
            if any(k in self.first[s] for k in kinds) or (self.null[s] and any(k in self.first[e] or (self.null[e] and k in self.follow[self.owner[state]]) for k in kinds)):
                calls.append((r, s, e))
        jumps = []
        for test, e in self.tests[state]:
            if test == "@asi" and (fresh or kinds[0] in _ASI_STOP) or test == "@expr" and kinds[0] not in _NOT_EXPR:
                jumps.append(e)
        pop = self.final[state] and any(k in self.follow[self.owner[state]] for k in kinds)
        return shifts, calls, jumps, pop

    def step(self, state: int, tok: tuple):
        """What a descriptor does before a token, worked out once per state and token.

        (shifts, nodes, inner, pop): states after the token with the descriptor's own stack node; rules called on the
        way, each with its callers (state after the call, calling rule or None for the own node); states after the
        token inside those rules; and whether the own rule may end here. Rules that shift nothing here are left out.
        """
        callers: dict = {}
        shifts, ended, pop = set(), set(), False
        todo, seen = [(state, None)], set()
        while todo:
            d = todo.pop()
            if d in seen:
                continue
            seen.add(d)
            at, rule = d
            own, calls, jumps, final = self.action(at, *tok)
            shifts.update((e, rule) for e in own)
            todo.extend((e, rule) for e in jumps)
            for r, s, e in calls:
                edge = (e, rule)
                if r not in callers:
                    callers[r] = [edge]
                    todo.append((s, r))
                elif edge not in callers[r]:
                    callers[r].append(edge)
                    if r in ended:
                        todo.append(edge)
            if final:
                if rule is None:
                    pop = True
                elif rule not in ended:
                    ended.add(rule)
                    todo.extend(callers[rule])
        needed, back = set(), [r for _, r in shifts if r is not None]
        while back:
            r = back.pop()
            if r not in needed:
                needed.add(r)
                back.extend(c for _, c in callers[r] if c is not None)
        nodes = tuple((r, tuple(callers[r])) for r in needed)
        return tuple(e for e, r in shifts if r is None), nodes, tuple((e, r) for e, r in shifts if r is not None), pop

    def _reset(self) -> None:
        """Forget all interned stacks and moves; they are worked out again when needed."""
        self._nodes: dict = {}
        self._edges: list[tuple] = []
        self._configs: dict = {}
        self._members: list[tuple] = []
        self._moves: list[dict] = []
        roots = [self._node(s, ()) for s in self.starts]
        self._roots = frozenset(roots)
        self._begin = self._config((self.start[s], r) for s, r in zip(self.starts, roots))

    def _node(self, rule: str, callers) -> int:
        """The stack node of a rule with these callers; equal stacks are one node, in whatever file they arise."""
        key = (rule, frozenset(callers)) if callers else (rule, None)
        got = self._nodes.get(key)
        if got is None:
            got = self._nodes[key] = len(self._edges)
            self._edges.append(tuple(callers))
        return got

    def _config(self, descriptors) -> int:
        """A set of descriptors (state, node), numbered."""
        key = frozenset(descriptors)
        got = self._configs.get(key)
        if got is None:
            got = self._configs[key] = len(self._members)
            self._members.append(tuple(key))
            self._moves.append({})
        return got

    def _settle_nodes(self, fresh: dict[str, list]) -> dict[str, int]:
        """Numbers of the rules called at one token. fresh: rule -> callers (state, number of a node or rule of this token)."""
        done: dict[str, int] = {}
        open_: set[str] = set()
        for top in fresh:
            stack = [top]
            while stack:
                r = stack[-1]
                if r in done:
                    stack.pop()
                    continue
                waiting = [by for _, by in fresh[r] if isinstance(by, str) and by not in done]
                if not waiting:
                    done[r] = self._node(r, {(e, done[by] if isinstance(by, str) else by) for e, by in fresh[r]})
                    open_.discard(r)
                    stack.pop()
                elif r in open_ or any(by in open_ for by in waiting):
                    return self._cyclic(fresh)
                else:
                    open_.add(r)
                    stack.extend(waiting)
        return done

    def _cyclic(self, fresh: dict[str, list]) -> dict[str, int]:
        """Rules that call themselves before any token make stacks with cycles; these are not shared with other files."""
        at = {}
        for r in fresh:
            at[r] = len(self._edges)
            self._edges.append(())
        for r, callers in fresh.items():
            self._edges[at[r]] = tuple({(e, at[by] if isinstance(by, str) else by) for e, by in callers})
        return at

    def _advance(self, config: int, tok) -> int:
        """The configuration after a token, ACCEPTED or REJECTED."""
        steps, edges = self._actions, self._edges
        cur = list(self._members[config])
        last = tok[0][0] == EOF
        done, nxt, inner, fresh = set(cur), set(), set(), {}
        accepted = False
        while cur:
            state, node = cur.pop()
            plan = steps.get((state, tok))
            if plan is None:
                plan = steps[state, tok] = self.step(state, tok)
            shifts, called, deeper, pop = plan
            nxt.update((e, node) for e in shifts)
            for r, callers in called:
                held = fresh.setdefault(r, [])
                for e, by in callers:
                    edge = (e, node if by is None else by)
                    if edge not in held:
                        held.append(edge)
            inner.update(deeper)
            if pop:
                if last and node in self._roots:
                    accepted = True
                for d in edges[node]:
                    if d not in done:
                        done.add(d)
                        cur.append(d)
        if accepted:
            out = ACCEPTED
        elif not nxt and not inner:
            out = REJECTED
        else:
            at = self._settle_nodes(fresh)
            out = self._config(nxt | {(e, at[r]) for e, r in inner})
        self._moves[config][tok] = out
        return out

    def accepts(self, tokens) -> bool:
        """tokens: (kinds, fresh) each, kinds a tuple of the terminals a token may be. All start rules run together.

        A stack node is the set of its callers: (state after the call, caller's node). A rule called at a token has one
        node there, whoever calls it. Nodes with the same callers are the same node, and so are sets of descriptors; so
        what a token does is worked out once for each set, and looked up wherever the same stacks arise again.
        """
        if len(self._members) > MOST_CONFIGS:
            self._reset()
        at, moves = self._begin, self._moves
        for tok in tokens:
            to = moves[at].get(tok)
            if to is None:
                to = self._advance(at, tok)
            if to < 0:
                return to == ACCEPTED
            at = to
        return False
