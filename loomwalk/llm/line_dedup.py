"""Fuzzy line deduplication: sketches of normalised lines, pigeonhole blocks, edit similarity, connected groups; DataFrame functions only.

A SimHash of equal weights can't serve lines: one replaced word in ten turns a tenth of the votes, about 9 of 64 bits, and blocks that survive
that are too short to tell lines apart.  So the votes are weighted: the words of a line are ranked, and each outweighs all that come after it.  Then
the bits are those of the first word's hash; left out, those of the second, and so on.  The sketch is the first SKETCH such hashes, and
each is a block.  A replaced, inserted or deleted word changes one block of a line at most, wherever it stands, so lines that are two words apart
agree in AGREE blocks of five for certain, and are joined on every choice of so many blocks.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, flag_in, maybe_in
from .linkage import link_buckets, shared_buckets

#: Blocks of a line, and how many of them candidates have in common.
SKETCH, AGREE = 5, 3
#: Candidates also have so many in common of a larger sketch, or the same share of a smaller one.
LARGE, SHARED = 16, 9
#: Lines of a bucket that one row holds, when a bucket of more than MOST lines is searched for the links that its first line has not made.
BLOCK, MOST = 256, 9
#: Least edit similarity of linked lines, in percent.
SIMILARITY = 80
#: Edit similarity counts characters, and words where a line has more characters than this.
WORDWISE = 4000
#: The least id: it stands for a null one, which sorts first.
_NO_ID = -(1 << 63)

#: Scripts that are written without spaces: their features are pairs of characters.
_DENSE = r"\x{E00}-\x{EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{2E80}-\x{2FDF}\x{3005}-\x{3007}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF66}-\x{FF9F}\x{20000}-\x{3FFFF}"
#: Letters and digits: all but the rest of ASCII and the punctuation of Latin-1, of Unicode and of full width.  Those of Latin-1 are a class of their own, and come
#: one by one: Java makes a table of them, which it looks into first.
_LATIN = "abcdefghijklmnopqrstuvwxyz0123456789" + "".join(map(chr, (0xAA, 0xB5, 0xBA, *range(0xC0, 0x100))))
_WORD = rf"[{_LATIN}][\x{{100}}-\x{{1FFF}}\x{{2070}}-\x{{2FFF}}\x{{3005}}-\x{{3007}}\x{{3040}}-\x{{30FA}}\x{{30FC}}-\x{{FEFF}}\x{{FF10}}-\x{{FF19}}\x{{FF21}}-\x{{FF3A}}\x{{FF41}}-\x{{FF5A}}\x{{FF66}}-\x{{10FFFF}}]"


def _once(df: DataFrame, keep: list[str], value: Column, name: str) -> DataFrame:
    """``df`` with a column that later filters read but don't compute again: predicates are not pushed through a generator."""
    return df.select(*keep, F.explode(F.array(value)).alias(name))


def lines_of(text: Column) -> Column:
    """The lines of a text with their line ends, and an empty string after a last line end; joined they are the text."""
    return F.split(text, r"(?<=\n)")


def words_of(line: Column) -> Column:
    """The lower-cased words of a line."""
    return F.regexp_extract_all(F.lower(line), F.lit(f"[{_WORD}]+"), F.lit(0))


def normal_line(line: Column) -> Column:
    """The lower-cased words of a line with one space between two of them."""
    return F.array_join(words_of(line), " ")


def _dense(norm: Column) -> Column:
    """Most characters take three bytes or more."""
    return F.octet_length(norm) > 2 * F.length(norm)


def features_of(norm: Column, words: Column | None = None) -> Column:
    """The words of a line; in scripts without spaces, its pairs of neighbouring characters."""
    words = F.split(norm, " ") if words is None else words
    return F.when(_dense(norm), F.regexp_extract_all(norm, F.lit(r"(?=(\S\S))"), F.lit(1))).otherwise(words)


def ranks_of(features: Column) -> Column:
    """Hashes of features, each halved for every byte, so that long words, which are mostly rare, come first."""
    return F.transform(features, lambda w: F.call_function("shiftrightunsigned", F.xxhash64(w), F.octet_length(w)))


def sketch(features: Column, size: int = SKETCH) -> Column:
    """The blocks of a line: the ``size`` least ranks of its features."""
    return least(ranks_of(features), size)


def least(ranks: Column, size: int = SKETCH) -> Column:
    return F.slice(F.sort_array(F.array_distinct(ranks)), 1, size)


def _keys(blocks: list[Column]) -> Column:
    """Hashes of every choice of AGREE blocks; null where blocks are missing."""
    return F.array(*[F.when(x[-1].isNotNull(), F.xxhash64(*x)) for x in combinations(blocks, AGREE)])


def _pieces(norm: Column) -> Column:
    return F.regexp_extract_all(norm, F.lit(f"[{_DENSE}]|[^ {_DENSE}]+"), F.lit(0))


def _code(words: Column) -> Column:
    """The words as characters, 20 bits of a hash each: edit distances of such strings count words."""

    def character(w: Column) -> Column:
        h = F.xxhash64(w)
        high, low = F.shiftright(h, 10).bitwiseAND(F.lit(1023)), h.bitwiseAND(F.lit(1023))
        return F.hex(F.lit(0xD800DC00).cast("long") + high * 65536 + low)  # a surrogate pair

    return F.decode(F.unhex(F.array_join(F.transform(words, character), "")), "UTF-16BE")


def _let(value: Column, f) -> Column:
    """``f(value)``, the value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _once_in(words: Column) -> Column:
    """The words that come once, in their order."""
    twice = _let(F.sort_array(words), lambda s: F.filter(s, lambda w, i: w == F.get(s, i + 1)))
    return F.array_except(words, twice)


def _total(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0), lambda s, d: s + d)


def _within(x: Column, y: Column, most: Column) -> Column:
    """Whether the edit distances of the strings of two arrays, one by one, add up to ``most`` at most.  Each is sought no further than what the earlier ones have left of it."""

    def spend(left: Column, p: Column) -> Column:
        d = F.call_function("levenshtein", p["a"], p["b"], left)  # -1 beyond left
        return F.when(left < 0, left).otherwise(left - F.pmod(d, left + 2))

    apart = F.array_compact(F.zip_with(x, y, lambda a, b: F.when(a != b, F.struct(a.alias("a"), b.alias("b")))))
    return _let(apart, lambda ps: F.when(F.size(ps) > most, False).otherwise(F.aggregate(ps, most, spend) >= 0))


def anchored(x: Column, y: Column, most: Column) -> Column:
    """Whether the edit distance of two lines, given as words, is at most ``most`` when words that both have once, in the same order, stay in place.

    That distance is never below the plain one and mostly equal to it; but only what lies between such words is compared character by character."""

    def between(words: Column, anchors: Column) -> Column:
        return F.split(F.array_join(F.transform(words, lambda w: F.when(F.array_contains(anchors, w), "\n").otherwise(w)), " "), "\n")

    def common(once: Column) -> Column:
        same = F.zip_with(F.array_intersect(once["x"], once["y"]), F.array_intersect(once["y"], once["x"]), lambda a, b: F.when(a == b, a))
        return F.array_compact(same)

    def close(gap: Column) -> Column:
        least = _total(F.zip_with(gap["x"], gap["y"], lambda a, b: F.abs(F.length(a) - F.length(b))))
        return F.when(least > most, False).otherwise(_within(gap["x"], gap["y"], most))

    once = F.struct(_once_in(x).alias("x"), _once_in(y).alias("y"))
    return _let(_let(once, common), lambda anchors: _let(F.struct(between(x, anchors).alias("x"), between(y, anchors).alias("y")), close))


def similar(ta: Column, tb: Column, ca: Column, cb: Column) -> Column:
    """Whether the edit similarity is at least SIMILARITY percent: of the lines, or of their words as characters where a line is null.

    Lines whose words differ one for one are compared so; others share AGREE out of SKETCH words at least, by the line with more different ones, and are compared
    between anchors; those in scripts without spaces plainly."""

    def most(x: Column, y: Column) -> Column:
        return F.floor(F.greatest(F.length(x), F.length(y)) * (100 - SIMILARITY) / 100).cast("int")

    def within(x: Column, y: Column) -> Column:
        return F.call_function("levenshtein", x, y, most(x, y)) >= 0

    def near(x: Column, y: Column) -> Column:
        return F.abs(F.length(x) - F.length(y)) <= most(x, y)

    def plain(words: Column) -> Column:
        x, y = words["x"], words["y"]
        share = F.size(F.array_intersect(x, y)) * SKETCH >= F.greatest(F.size(F.array_distinct(x)), F.size(F.array_distinct(y))) * AGREE
        word_by_word = (F.size(x) == F.size(y)) & _within(x, y, most(ta, tb))
        return F.when(word_by_word, True).when(_dense(ta), within(ta, tb)).when(~share, False).otherwise(anchored(x, y, most(ta, tb)))

    words = F.struct(F.split(ta, " ").alias("x"), F.split(tb, " ").alias("y"))
    return F.when(ta.isNotNull() & tb.isNotNull(), near(ta, tb) & _let(words, plain)).otherwise(near(ca, cb) & within(ca, cb))


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, mark, text): rows with the same id are told apart by a hash of their text."""
    src = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_NO_ID)).alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return src.select("doc_id", F.xxhash64("text").alias("mark"), "text")


def _lines(src: DataFrame) -> DataFrame:
    return src.select("doc_id", "mark", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


_PLACE = ["doc_id", "mark", "pos"]


def _node(norm: Column) -> Column:
    return F.unhex(F.md5(norm.cast("binary")))


def _sketched(src: DataFrame) -> DataFrame:
    """(doc_id, mark, pos, node, s0, s1, ...): the lines that have words, with a hash of all words and their blocks."""
    found = _once(_lines(src), _PLACE, words_of(F.col("line")), "words").where("size(words) > 0")
    found = _once(found, [*_PLACE, "words"], F.array_join("words", " "), "norm")
    # A generator with a lambda is interpreted, with all that it computes; so the lambda stands before it.
    found = found.select(*_PLACE, _node(F.col("norm")).alias("node"), ranks_of(features_of(F.col("norm"), F.col("words"))).alias("ranks"))
    found = _once(found, [*_PLACE, "node"], least(F.col("ranks")), "sketch")
    return found.select(*_PLACE, "node", *[F.get("sketch", F.lit(i)).alias(f"s{i}") for i in range(SKETCH)])


def _drop_lists(rows: DataFrame, classes: DataFrame, comp: DataFrame) -> DataFrame:
    """(doc_id, mark, drop) from the places (doc_id, mark, pos, node), the distinct lines (node, n) and the groups (node, component) of the linked ones."""
    # Only lines that are linked or occur twice matter from here on.
    linked = maybe_in(classes, F.col("node"), comp, F.col("node")).join(comp, "node")
    alone = classes.where("n > 1").join(comp, "node", "left_anti").withColumn("component", F.col("node"))
    grouped = cut(linked.select("node", "component").unionByName(alone.select("node", "component")), "line-groups")
    # A common line is a common key of these joins, whose rows are a few bytes; skewed keys are split at run time.
    near = maybe_in(rows.select(*_PLACE, "node"), F.col("node"), grouped, F.col("node"))
    near = cut(near.join(grouped, "node").select(*_PLACE, "component"), "line-places")
    first = cut(near.groupBy("component").agg(F.min(F.struct(*_PLACE)).alias("first")), "line-firsts")
    gone = near.join(first, "component").where(F.struct(*_PLACE) != F.col("first"))
    return gone.groupBy("doc_id", "mark").agg(F.array_sort(F.collect_set("pos")).alias("drop"))


def repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, mark, drop): for each document with lines to drop, their sorted 0-based numbers.

    Documents are read twice: for the sketches of all lines, and for the characters of those that share a key with another line."""
    src = _documents(docs, id_col, text_col)
    rows = cut(_sketched(src), "line-rows")
    blocks = [f"s{i}" for i in range(SKETCH)]
    place = F.xxhash64(*_PLACE)
    classes = rows.groupBy("node").agg(*[F.min(b).alias(b) for b in blocks], F.count(F.lit(1)).alias("n"), F.min(place).alias("home"))
    classes = cut(classes, "line-classes")
    keys = classes.select("node", F.explode(_keys([F.col(b) for b in blocks])).alias("bucket")).where("bucket is not null")
    buckets = shared_buckets(keys, "line-buckets")
    wanted = cut(buckets.select("node").dropDuplicates().join(classes, "node").select("node", "home"), "line-wanted")
    again = maybe_in(_lines(src).withColumn("home", place), F.col("home"), wanted, F.col("home"))
    again = _once(again, ["home"], normal_line(F.col("line")), "norm").select("home", "norm", _node(F.col("norm")).alias("node"))
    chars = F.length("norm")
    texts = again.join(wanted, ["node", "home"]).dropDuplicates(["node"])
    about = F.struct(chars.alias("size"), sketch(features_of(F.col("norm")), LARGE).alias("blocks"))
    texts = cut(texts.select("node", about.alias("about"), F.when(chars <= WORDWISE, F.col("norm")).alias("line"), F.when(chars > WORDWISE * SIMILARITY // 100 - 1, _code(_pieces(F.col("norm")))).alias("code")), "line-texts")

    def verify(pairs: DataFrame) -> DataFrame:
        side = lambda x: texts.select(F.col("node").alias(x), F.col("line").alias(f"t{x}"), F.col("code").alias(f"c{x}"))
        return pairs.join(side("a"), "a").join(side("b"), "b").where(similar(*[F.col(c) for c in ("ta", "tb", "ca", "cb")])).select("a", "b")

    def alike(x: Column, y: Column) -> Column:
        size = F.least(x["size"], y["size"]) * 100 >= F.greatest(x["size"], y["size"]) * SIMILARITY
        return size & (F.size(F.array_intersect(x["blocks"], y["blocks"])) * LARGE >= F.greatest(F.size(x["blocks"]), F.size(y["blocks"])) * SHARED)

    def finish(live: DataFrame) -> DataFrame:
        """Each line outside the largest component of its bucket against the lines of other components, in blocks: a row for a line and a block, none for a pair.
        Two lines are compared in one bucket only, that of their first common blocks, and a line not with the rest of a component once it is linked to a line of it."""
        fields = ["node", "component", "about", "line", "code"]
        whole = live.join(texts.select("node", "line", "code"), "node").select("bucket", "c", F.struct(*fields).alias("x"))
        main = live.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("m")).select("bucket", F.col("m.component").alias("main"))
        parts = F.ceil(F.col("c") / BLOCK)
        part = F.pmod(F.xxhash64("x.node"), parts)
        blocks = whole.groupBy("bucket", part.alias("part")).agg(F.collect_list("x").alias("ys"))
        x = F.col("x")

        def linked(y: Column) -> Column:
            first = F.array_intersect(F.slice(x["about"]["blocks"], 1, SKETCH), F.slice(y["about"]["blocks"], 1, SKETCH))
            here = F.xxhash64(*[F.get(first, F.lit(i)) for i in range(AGREE)]) == F.col("bucket")
            new = (y["component"] != x["component"]) & ((y["component"] == F.col("main")) | (x["node"] < y["node"]))
            return new & alike(x["about"], y["about"]) & here & similar(x["line"], y["line"], x["code"], y["code"])

        probes = whole.join(main, "bucket").where(F.col("x.component") != F.col("main")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("c")
        probes = probes.join(blocks, ["bucket", "part"])  # dealt by blocks, so that a crowded bucket is many keys
        none = F.array().cast("array<struct<node: binary, component: binary>>")

        def add(s: Column, y: Column) -> Column:
            here = F.struct(y["node"].alias("node"), y["component"].alias("component"))
            return F.when(~F.exists(s, lambda z: z["component"] == y["component"]) & linked(y), F.array_append(s, here)).otherwise(s)

        return probes.select(F.col("x.node").alias("a"), F.explode(F.aggregate("ys", none, add)).alias("y")).select("a", F.col("y.node").alias("b"))

    live = cut(buckets.join(texts.select("node", "about"), "node"), "line-live")
    _, comp = link_buckets(live, alike, verify, finish, MOST)
    return _drop_lists(rows, classes, comp)


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``text`` less its repeated lines, and (n_lines, n_dropped) added.

    A line is a run up to a line end, whatever its length.  Lines are compared by their lower-cased words, between which stands one space.  Equal
    lines are always linked, however short; lines without a word always stay.  Other lines are candidates if they share AGREE of their SKETCH
    blocks (so they have three different words at least) and about as many of the LARGE first ones, and linked if their lengths differ by a fifth at most and their edit similarity
    is at least 0.8: in characters, with words that both lines have once, in the same order, kept in place, or in words where a line has more than WORDWISE
    characters.  Lines with three fifths of their words in common are compared, and those that differ word for word.  In scripts without spaces each pair of characters counts as a word of the sketch.
    Of each connected group the occurrence with the smallest (id, hash of the text, line number) stays; all others go, also within one document.

    Null texts count as empty and stay null; empty texts have no lines.  Rows that repeat an id are documents of their own; those that
    repeat id and text are one and treated alike.  A null id sorts first; other ids are whole numbers.  Other columns pass through
    whatever their names, save that ``n_lines`` and ``n_dropped`` are replaced.

    Texts move only for documents that lose lines, and once.
    """
    drops = cut(repeated_lines(docs, id_col=id_col, text_col=text_col), "line-drops")
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_NO_ID)).alias("__id"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("__mark"))
    flagged = flag_in(packed, F.xxhash64("__id", "__mark"), drops, F.xxhash64("doc_id", "mark"))
    text = F.col(f"__row.`{text_col}`")
    parts = F.split(F.coalesce(text, F.lit("")), "\n")
    n_lines = (F.size(parts) - (F.element_at(parts, -1) == "").cast("int")).cast("long")
    # Shuffled, as the lists grow with the corpus; built from the lists, so that texts aren't sorted.
    changed = flagged.where("__maybe").join(drops.hint("shuffle_hash"), (F.col("__id") == F.col("doc_id")) & (F.col("__mark") == F.col("mark")), "left")
    changed = changed.withColumn("__lines", lines_of(F.coalesce(text, F.lit(""))))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "drop"), lambda i: F.get("__lines", i))
    changed = changed.select("__row", F.when(F.col("drop").isNull(), text).otherwise(F.array_join(kept, "")).alias("__text"), n_lines.alias("n_lines"), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"))
    same = flagged.where("not __maybe").select("__row", text.alias("__text"), n_lines.alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"))
    out = changed.unionByName(same)
    return out.select(*[F.col("__text").alias(c) if c == text_col else F.col(f"__row.`{c}`").alias(c) for c in names], "n_lines", "n_dropped")


def report(docs: DataFrame) -> DataFrame:
    """Per document: (doc_id, n_lines, n_dropped, n_chars, text_sha256) of the text that is left."""
    out = dedup_lines(docs.select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "n_lines", "n_dropped", F.length(text).cast("long").alias("n_chars"), F.sha2(text.cast("binary"), 256).alias("text_sha256"))
