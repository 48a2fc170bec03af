"""Cheapest repair of a sequence of messages by depth-first branch and bound.

A message is (fault, initial): fault is SOUND, DOOMED (must go) or CUT (ends in the middle), initial
the first character of its role. Messages are kept (K), deleted (D) or given another role (R), and
empty ones are inserted (I), so that the initials read `(s?(ua)+)?`. The state says what has been
emitted: START nothing, SYSTEM, USER or ASSISTANT the last one.

The search keeps its nodes (messages done, state, cost, edits so far) on a stack of its own and goes
down the most promising edit first. It drops a node if

* its cost and the suffix bound exceed the best complete repair, or equal it while its edits
  already come after it in ASCII order. The bound of a suffix and a state is the least that the
  remaining messages cost when it does not matter where they end;
* the table of its place (messages done, state) holds a prefix that is cheaper, or as cheap and
  not later in ASCII order. Of two prefixes of one place and cost neither starts with the other (the
  rest would be insertions, which cost), so the better one stays better however they go on.

When the stack is empty, the best repair is proved to be the cheapest, ties to the ASCII-least edits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

SOUND, DOOMED, CUT = range(3)
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = START, SYSTEM, USER, ASSISTANT
#: States in which a conversation may end.
COMPLETE = frozenset((START, ASSISTANT))
REROLE, DELETE, INSERT, CUT_KEPT = 1, 2, 5, 5
#: Messages of one search; longer sequences are searched in parts that are joined at every state.
PART = 128

Message = tuple[int, str]
Repair = tuple[int, str]
#: The cheapest repair from each entry to each exit state.
Paths = dict[tuple[int, int], Repair]


def kept(state: int, initial: str) -> int | None:
    """The state after a message of this initial, none where it may not come."""
    if initial == "u":
        return None if state == USER else USER
    if initial == "a":
        return ASSISTANT if state == USER else None
    return SYSTEM if initial == "s" and state == START else None


def other(state: int) -> int:
    """The state after the message that a change of role or an insertion gives."""
    return ASSISTANT if state == USER else USER


def suffix_bounds(messages: list[Message]) -> list[tuple[int, ...]]:
    """For each suffix and state the least that its messages cost, wherever they end.

    The end that is required, and with it every closing insertion, is left to the search.
    """
    below = (0, 0, 0, 0)
    out = [below]
    for fault, initial in reversed(messages):
        more = CUT_KEPT if fault == CUT else 0
        least = [DELETE + below[state] for state in STATES]
        if fault != DOOMED:
            for state in STATES:
                same = kept(state, initial)
                stay = more + below[same] if same is not None else least[state]
                least[state] = min(least[state], stay, REROLE + more + below[other(state)])
        # An insertion before the message; after two of them a state is itself again.
        turned = [INSERT + least[other(state)] for state in STATES]
        below = tuple(min(least[state], turned[state], INSERT + turned[other(state)]) for state in STATES)
        out.append(below)
    return out[::-1]


def search(
    messages: list[Message], entry: int = START, goals: Iterable[int] = COMPLETE, rest: list[tuple[int, ...]] | None = None
) -> tuple[Repair | None, int]:
    """The cheapest repair from `entry` to one of `goals`, and how many nodes were opened.

    `rest` are the suffix bounds, where they are known already.
    """
    goals = frozenset(goals)
    count = len(messages)
    rest = suffix_bounds(messages) if rest is None else rest
    best: Repair | None = None
    tables: dict[tuple[int, int], Repair] = {}
    stack = [(0, entry, 0, "")]
    opened = 0
    while stack:
        at, state, cost, edits = stack.pop()
        if best is not None:
            bound = cost + rest[at][state]
            if bound > best[0] or bound == best[0] and edits > best[1][: len(edits)]:
                continue
        seen = tables.get((at, state))
        if seen is not None and seen <= (cost, edits):
            continue
        tables[at, state] = cost, edits
        opened += 1
        if at == count and state in goals and (best is None or (cost, edits) < best):
            best = cost, edits
        turned = other(state)
        steps = [(INSERT + rest[at][turned], "I", at, turned, INSERT)]
        if at < count:
            fault, initial = messages[at]
            after = rest[at + 1]
            steps.append((DELETE + after[state], "D", at + 1, state, DELETE))
            if fault != DOOMED:
                more = CUT_KEPT if fault == CUT else 0
                steps.append((REROLE + more + after[turned], "R", at + 1, turned, REROLE + more))
                same = kept(state, initial)
                if same is not None:
                    steps.append((more + after[same], "K", at + 1, same, more))
        steps.sort(reverse=True)  # the cheapest is taken from the stack first, ties in ASCII order
        stack.extend((to, new, cost + price, edits + edit) for _, edit, to, new, price in steps)
    return best, opened


def paths(messages: list[Message]) -> Paths:
    """The cheapest repairs of one part between all states."""
    out, rest = {}, suffix_bounds(messages)
    for entry in STATES:
        for goal in STATES:
            if goal == START and entry != START or goal == SYSTEM and entry in (USER, ASSISTANT):
                continue
            found, _ = search(messages, entry, (goal,), rest)
            if found is not None:
                out[entry, goal] = found
    return out


def joined(first: Paths | None, second: Paths) -> Paths:
    """The cheapest repairs of two sequences, one after the other."""
    if first is None:
        return second
    out: Paths = {}
    for (entry, middle), (cost, edits) in first.items():
        for (start, goal), (more, rest) in second.items():
            if start == middle:
                whole = cost + more, edits + rest
                if (entry, goal) not in out or whole < out[entry, goal]:
                    out[entry, goal] = whole
    return out


def cheapest(found: Paths) -> Repair:
    """The repair of a whole conversation."""
    return min(found[START, goal] for goal in COMPLETE if (START, goal) in found)


class Lines:
    """The repaired lines of messages that are given one by one, by the edits of the whole."""

    def __init__(self, edits: str):
        self.edits, self.at, self.state = edits, 0, START

    def inserted(self) -> Iterator[str]:
        while self.edits[self.at : self.at + 1] == "I":
            self.at += 1
            self.state = other(self.state)
            yield f"{'user' if self.state == USER else 'assistant'}:"

    def of(self, role: str, text: str) -> Iterator[str]:
        """Lines up to and with those of the next message."""
        yield from self.inserted()
        edit = self.edits[self.at]
        self.at += 1
        if edit == "K":
            self.state = kept(self.state, role[:1])
            yield f"{role}:{text}"
        elif edit == "R":
            self.state = other(self.state)
            yield f"{'user' if self.state == USER else 'assistant'}:{text}"
