import zlib


def words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def grams(text, n=5):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def classes(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def crc(b):
    return zlib.crc32(b) & 0xFFFFFFFF


#: doc_id, text, lang, source, n_chars: nulls, empty and very long texts, ties and repeated rows.
LONG = " ".join(f"wort{i * 7919 % 1013}" for i in range(40_000))
EDGE = [
    (0, None, None, None, None),
    (1, "", "en", "a", 0),
    (2, "  \t\n ", "en", "a", 5),
    (3, "one two\tthree", "en", "a", None),
    (4, "one  two \n three", None, "b", 3),
    (4, "one  two \n three", None, "b", 3),
    (5, "one two three ", "de", "b", 3),
    (None, "one two three", "de", None, 3),
    (None, None, "de", None, 3),
    (6, LONG, "de", "c", 3),
    (7, LONG + " end", "de", "c", 3),
    (8, "1234 5678 !!", "de", "c", 3),
    (9, "<|endoftext|> it's  he'll 'tis   x　y \U0001f600 naïve œuvre 漢字", "fr", "c", 3),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def edge(spark):
    """With extra columns that clash with outputs and with names inside the operators."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(EDGE, SCHEMA).withColumns({"kept": F.lit("x"), "Size": F.lit("y"), "node": F.lit(1), "shard": F.lit(2), "id": F.lit(3), "n": F.lit(4), "target": F.lit(5), "score": F.lit("z"), "length": F.lit("q")})


def none(spark):
    return edge(spark).where("false")
