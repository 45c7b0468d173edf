"""Labelled blocks from which the tree of html_text learns, written by hand.

container: 0 none, 1 article or main, 2 nav, menu or sidebar, 3 page header or footer,
4 advert or dialog, 5 comments, 6 a form, or an element that its class, id or role alone puts
in 2 to 4: there many words with few links are content. heading: 1 for h1 to h6. Words and link density are
those of the block, of the block before and of the block after (0 at the page's ends).
"""

#: container, heading, words, density, words before, density before, words after, density after; 1 content.
BLOCKS = """
1 1 12 0.0 14 0.0 60 0.0 1
1 1 3 0.0 9 1.0 40 0.0 1
1 1 9 0.0 0 0.0 12 0.0 1
1 1 6 1.0 5 0.0 30 0.0 1
1 0 45 0.0 12 0.0 60 0.0 1
1 0 80 0.05 45 0.0 30 0.0 1
1 0 120 0.0 80 0.1 12 0.0 1
1 0 1 0.0 40 0.0 55 0.0 1
1 0 2 0.0 1 0.0 3 0.0 1
1 0 4 0.0 60 0.0 20 0.0 1
1 0 15 0.3 33 0.0 45 0.0 1
1 0 25 0.5 40 0.1 30 0.1 1
1 0 7 0.0 4 0.0 0 0.0 1
1 0 33 0.0 2 0.0 14 0.1 1
1 0 3 1.0 50 0.0 44 0.0 1
1 0 200 0.02 33 0.0 150 0.0 1
1 0 6 0.0 22 0.0 18 0.5 1
1 0 12 0.1 12 0.0 11 0.0 1
0 0 60 0.0 70 0.0 55 0.0 1
0 0 45 0.1 12 0.0 60 0.0 1
0 0 35 0.0 50 0.0 3 1.0 1
0 0 110 0.03 4 1.0 80 0.0 1
0 0 30 0.1 90 0.0 40 0.0 1
0 0 22 0.0 40 0.0 35 0.0 1
0 1 8 0.0 3 1.0 60 0.0 1
0 1 10 0.0 0 0.0 45 0.0 1
0 0 8 0.0 60 0.0 45 0.0 1
0 0 12 0.0 44 0.0 70 0.0 1
0 0 3 1.0 2 1.0 4 1.0 0
0 0 1 1.0 1 1.0 1 1.0 0
0 0 5 0.8 3 1.0 2 1.0 0
0 0 4 0.0 2 1.0 3 1.0 0
0 0 9 0.6 5 0.9 6 1.0 0
0 1 2 0.0 3 1.0 4 1.0 0
0 0 2 0.0 1 1.0 0 0.0 0
0 0 7 1.0 0 0.0 60 0.0 0
0 0 25 0.9 4 1.0 30 0.9 0
2 0 1 1.0 0 0.0 1 1.0 0
2 0 2 1.0 1 1.0 3 1.0 0
2 0 1 1.0 1 1.0 15 0.0 0
2 0 40 0.1 3 1.0 30 0.0 0
2 1 3 0.0 1 1.0 2 1.0 0
2 0 60 0.0 2 1.0 90 0.0 0
2 0 6 0.0 40 0.0 5 1.0 0
3 0 12 0.0 60 0.0 0 0.0 0
3 0 14 0.1 5 0.0 0 0.0 0
3 0 40 0.0 80 0.0 0 0.0 0
3 0 3 1.0 12 0.0 4 1.0 0
3 1 4 0.0 0 0.0 2 1.0 0
3 0 90 0.0 0 0.0 3 1.0 0
4 0 12 0.0 2 1.0 14 0.0 0
4 0 14 0.0 1 1.0 10 0.0 0
4 0 30 0.1 0 0.0 8 1.0 0
4 0 5 0.0 60 0.0 60 0.0 0
4 0 70 0.0 40 0.0 44 0.0 0
4 1 4 0.0 3 0.0 20 0.0 0
5 0 20 0.0 12 0.0 33 0.0 0
5 0 55 0.0 20 0.0 44 0.0 0
5 0 3 1.0 55 0.0 20 0.0 0
5 1 2 0.0 90 0.0 4 0.0 0
6 0 60 0.0 70 0.0 55 0.0 1
6 0 45 0.1 12 0.0 60 0.0 1
6 0 35 0.0 50 0.0 3 1.0 1
6 0 110 0.03 4 1.0 80 0.0 1
6 0 40 0.0 3 1.0 0 0.0 1
6 0 70 0.0 0 0.0 0 0.0 1
6 1 8 0.0 3 1.0 60 0.0 1
6 1 5 0.0 0 0.0 45 0.0 1
6 0 22 0.0 40 0.0 35 0.0 1
6 0 14 0.0 1 1.0 3 0.0 0
6 0 12 0.0 2 1.0 14 0.0 0
6 0 6 0.0 22 0.0 18 0.0 0
6 0 5 0.0 60 0.0 60 0.0 0
6 0 2 0.0 15 0.0 10 0.0 0
6 0 3 0.0 3 1.0 60 0.0 0
6 0 9 0.0 3 1.0 45 0.0 0
6 0 4 0.0 0 0.0 60 0.0 0
6 0 3 1.0 2 1.0 4 1.0 0
6 0 25 0.9 4 1.0 30 0.9 0
6 0 40 0.8 3 1.0 30 0.9 0
6 1 3 0.0 1 1.0 2 1.0 0
"""


def rows() -> list[tuple[list[float], float]]:
    """(features, label) of each block."""
    numbers = [[float(v) for v in line.split()] for line in BLOCKS.split("\n") if line]
    return [(n[:-1], n[-1]) for n in numbers]
