"""The models that the queries compare the tables with."""

from petrilake.operators.nets import Net

#: Journeys of users: sign up, view, click and retry, then purchase, or leave silently.
SHOP = Net(
    (
        ("t1", "signup", False, ("p0",), ("p1",)),
        ("t2", "view", False, ("p1",), ("p2",)),
        ("t3", "click", False, ("p2",), ("p2",)),
        ("t4", "error", False, ("p2",), ("p1",)),
        ("t5", "purchase", False, ("p2",), ("p3",)),
        ("t6", "tau", True, ("p1",), ("p3",)),
    ),
    ("p0",),
)
#: Conversations: an optional system turn, then turns of user and assistant in pairs.
CHAT = Net(
    (
        ("c1", "system", False, ("q0",), ("q1",)),
        ("c2", "tau", True, ("q0",), ("q1",)),
        ("c3", "user", False, ("q1",), ("q3",)),
        ("c4", "assistant", False, ("q3",), ("q1",)),
        ("c5", "tau2", True, ("q1",), ("q2",)),
    ),
    ("q0",),
)
#: A tree: the first turns of a conversation, with two branches that end alike.
TREE = Net(
    (
        ("d1", "system", False, ("r0",), ("r1",)),
        ("d2", "user", False, ("r1",), ("r2",)),
        ("d3", "assistant", False, ("r2",), ("r9",)),
        ("d4", "user", False, ("r0",), ("r3",)),
        ("d5", "assistant", False, ("r3",), ("r9",)),
    ),
    ("r0",),
    ("r9",),
)
#: Conversations that never ask twice in a row but may answer twice, and end with an answer.
SHORT = Net(
    (
        ("s1", "system", False, ("u0",), ("u1",)),
        ("s2", "user", False, ("u0",), ("u2",)),
        ("s3", "user", False, ("u1",), ("u2",)),
        ("s4", "assistant", False, ("u2",), ("u3",)),
        ("s5", "assistant", False, ("u3",), ("u4",)),
        ("s6", "user", False, ("u3",), ("u2",)),
        ("s7", "assistant", False, ("u2",), ("u4",)),
    ),
    ("u0",),
)
