"""Small inputs of our own for the queries that need games, boards and logs."""

_TAGS = '[Event "{0}"]\n[Site "here"]\n[Result "{1}"]\n'
GAMES = "\n\n".join(
    [
        _TAGS.format("knights out and back", "1/2-1/2") + "\n1. Nf3 Nf6 2. Ng1 Ng8 3. Nf3 Nf6 4. Ng1 Ng8 1/2-1/2",
        _TAGS.format("fool", "0-1") + "\n1. f3 {weak} e5 2. g4?? (2. d4 exd4 (2... Nc6 3. d5)) Qh4# 0-1",
        _TAGS.format("again", "*") + "\n1. Nf3 Nf6 2. Ng1 $6 Ng8 *",
        _TAGS.format("from a position", "*") + '[SetUp "1"]\n[FEN "8/8/8/8/8/4k3/4p3/4K3 w - - 0 1"]\n\n*',
        _TAGS.format("other rules", "*") + '[Variant "Atomic"]\n\n1. Nf3 *',
        _TAGS.format("wrong", "*") + "\n1. e4 e5 2. Ke3 *",
        _TAGS.format("castles", "1-0") + "\n1. e4 e5 2. Nf3 Nc6 3. Bb5 a6 4. O-O ; short\n4... Nf6 1-0",
        _TAGS.format("nothing", "*") + "\n*",
    ]
)

BOARDS = [
    ("rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1", 1),
    ("r3k2r/p1ppqpb1/bn2pnp1/3PN3/1p2P3/2N2Q1p/PPPBBPPP/R3K2R w Kq - 12 1", 2),
    ("8/8/4k3/8/2pP4/8/4K3/8 b - d3 0 1", 1),
    ("8/8/4k3/8/8/8/4K3/8 b - - 140 1", 7),
]

PUZZLES = [
    ("a", "g1", "6k1/5ppp/8/8/8/8/5PPP/3R2K1 b - - 0 1", "g8h8 d1d8", 900, ["mate"], ["d1d8"]),
    ("b", "g2", "6k1/5ppp/8/8/8/8/5PPP/3R2K1 b - - 0 1", "g8f8 d1d8", 1300, ["check"], ["d1d2"]),
    ("c", "g3", "k7/8/1K6/8/8/8/8/7R b - - 0 1", "a8b8 h1h8", 1700, ["mate"], ["h1h8"]),
    ("d", "g4", "7k/5Q2/8/8/8/8/8/K7 w - - 0 1", "f7g6 h8h7", 2100, ["none"], []),
]
