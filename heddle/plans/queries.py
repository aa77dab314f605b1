"""Every registered query of the library but those of its subpackages, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.constants import BINARY_EXTENSIONS, IGNORED_EXTENSIONS, IGNORED_NEEDLES, TITLES
from ..operators import classify, identity, ownership
from ..sources import porcelain, tables
from ..storage import scratch
from ..streaming import ownership as arrivals
from .snapshots import Snapshot


def classify_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.classify(tables.files(spark, sf_dir)).drop("kind")


def repository_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables.load(spark, sf_dir)
    return classify.repository_stats(t.files, t.authors)


def file_line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.load(spark, sf_dir).files.select("file_id", "path", "total_lines")


def author_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables.load(spark, sf_dir)
    return ownership.contributions(t.authors, t.blame).drop("title").orderBy("rank")


def author_ranking_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables.load(spark, sf_dir)
    return ownership.ranked_authors(t.authors, t.blame).select("id", "rank", "percentage", "title")


def author_file_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables.load(spark, sf_dir)
    return ownership.file_contributions(t.files, t.blame)


def extended_report_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables.load(spark, sf_dir)
    return ownership.top_files(t.files, t.blame, 5)


def developer_report_top15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the author of most lines' e-mail."""
    t = tables.load(spark, sf_dir)
    first = ownership.contributions(t.authors, t.blame).filter("rank = 1").select("email").first()
    return ownership.developer_report(t.authors, t.files, t.blame, first[0] if first else "", 15)


def pie_top10_others(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables.load(spark, sf_dir)
    return ownership.pie(ownership.contributions(t.authors, t.blame))


def glorious_lowly(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables.load(spark, sf_dir)
    return ownership.first_and_last(ownership.contributions(t.authors, t.blame))


def authors_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.load(spark, sf_dir).authors.select("id", "name", "email", "display_name")


def _people_as_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One author a person, e-mails repeating, ids by person."""
    return tables.people(spark, sf_dir).select(F.col("person").alias("id"), "name", "email", S.display_name(F.col("name")).alias("display_name"))


def normalize_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.normalize(_people_as_authors(spark, sf_dir), "strict").select("id", "canonical_id", "is_canonical")


def normalize_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.normalize(_people_as_authors(spark, sf_dir), "loose").select("id", "canonical_id", "is_canonical")


def author_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.aliases(identity.normalize(_people_as_authors(spark, sf_dir), "strict"))


def all_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = identity.all_authors(identity.normalize(_people_as_authors(spark, sf_dir), "strict"))
    return out.withColumn("aliases", F.array_join("aliases", "|"))


def find_canonical_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = identity.normalize(tables.load(spark, sf_dir).authors.drop("canonical_id", "is_canonical"), "strict")
    asked = tables.people(spark, sf_dir).select("email").distinct().unionByName(spark.createDataFrame([("nobody@none.example",)], "email string"))
    return identity.find_canonical(merged, asked)


def inactive_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all people as authors, those without lines in the first year."""
    authors = identity.normalize(_people_as_authors(spark, sf_dir), "strict")
    early = tables.lines(spark, sf_dir).filter(F.col("commit_ts") < "1992-02-01").select(F.col("person").alias("author_id"))
    return ownership.inactive(authors, identity.repointed(early, authors)).select("id", "email")


def _teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authors by person whose names come in threes: a word, the word with a first name after a comma, and with a suffix."""
    letters = lambda text: F.translate(F.md5(text.cast("binary")), "0123456789", "ghijklmnop")
    person = F.col("person")
    base = F.left(letters(F.concat(F.lit("t"), F.floor(person / 3).cast("string"))), F.lit(12))
    name = F.when(person % 3 == 1, F.concat(base, F.lit(", Y"))).when(person % 3 == 2, F.concat(F.initcap(base), F.lit("  jr."))).otherwise(base)
    email = F.concat(F.left(letters(F.concat(F.lit("m"), person.cast("string"))), F.lit(10)), F.lit("@d"), (person % 7).cast("string"), F.lit(".example"))
    return tables.people(spark, sf_dir).select(person.alias("id"), name.alias("name"), email.alias("email"), S.display_name(name).alias("display_name"))


def _team_lines(spark: SparkSession, sf_dir: str, authors: DataFrame) -> DataFrame:
    """Lines of analyzed files, but of every tenth team none, with their canonical authors."""
    known = classify.analyzed(classify.classify(tables.files(spark, sf_dir))).select("file_id")
    own = tables.lines_by_file(spark, sf_dir).filter("floor(person / 3) % 10 <> 0").join(known, "file_id", "left_semi")
    return identity.repointed(own.select(F.col("person").alias("author_id"), "file_id"), authors)


def author_contributions_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of merged authors count for the canonical one."""
    authors = identity.stored(identity.normalize(_teams(spark, sf_dir), "loose"))
    return ownership.contributions(authors, _team_lines(spark, sf_dir, authors)).orderBy("rank")


def ranked_authors_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All authors; those merged and those without lines have no place."""
    authors = identity.stored(identity.normalize(_teams(spark, sf_dir), "loose"))
    ranked = ownership.ranked_authors(authors, _team_lines(spark, sf_dir, authors))
    return ranked.select("id", "display_name", "canonical_id", "is_canonical", "rank", "percentage", "title")


def author_file_contributions_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of canonical authors, with the lines of those merged into them; a file's total is of these lines."""
    authors = identity.stored(identity.normalize(_teams(spark, sf_dir), "loose"))
    blame = _team_lines(spark, sf_dir, authors)
    return ownership.file_contributions(classify.with_total_lines(tables.files(spark, sf_dir), blame), blame)


def developers_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    authors = identity.stored(identity.normalize(_teams(spark, sf_dir), "loose"))
    return ownership.developers(authors, _team_lines(spark, sf_dir, authors))


def nth_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The author at the third place."""
    t = tables.load(spark, sf_dir)
    return ownership.nth(ownership.contributions(t.authors, t.blame), 3)


def clean_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with the white space and letters of several scripts, by each rule that reads names."""
    odd = F.array(*map(F.lit, ODD))
    rows = tables.people(spark, sf_dir).select("person", F.concat("name", F.get(odd, (F.col("person") % len(ODD)).cast("int")), F.lit("Müller")).alias("name"))
    name = F.col("name")
    return rows.select("person", S.clean_name(name).alias("clean"), S.display_name(name).alias("display"), S.has_artifacts(name).alias("artifacts"), S.is_blank(F.get(odd, (F.col("person") % len(ODD)).cast("int"))).alias("blank"))


#: What comes between two names.
ODD = (" ", "\xa0", "\u2003 ", "\ufeff", "\u2028", "\x85", ", ", "-", " 東京 ", "\t", ".", "'", "_9", " \u3000\x0b")


def nonblank_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents that are not blank, counted within each."""
    rows = tables.table(spark, sf_dir, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("all"))
    kept = F.filter("all", lambda x: ~S.is_blank(x))
    return rows.select("doc_id", F.posexplode(kept).alias("p", "content")).select("doc_id", (F.col("p") + 1).cast("long").alias("line_number"), F.sha2("content", 256).alias("content_sha256"))


def commit_iso_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.unix_timestamp("commit_ts")
    return tables.lines(spark, sf_dir).select("file_id", "line", "person", S.iso_time(seconds).alias("commit_date"))


def display_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables.load(spark, sf_dir)
    each = ownership.file_contributions(t.files, t.blame)
    cut = S.split_file_name(F.col("filename"))
    pct = F.col("percentage").cast("double")
    return each.select(
        "author_id", "path", S.short_base(cut["base"]).alias("base"), F.rpad(cut["ext"], 5, " ").alias("ext"), F.concat(F.lpad(F.concat(F.col("percentage").cast("string"), F.lit("%")), 4, " ")).alias("share"),
        S.ratio(F.col("author_lines"), F.col("total_lines")).alias("ratio"), S.bar(pct).alias("bar"), S.medal(F.col("author_lines")).alias("medal"), S.capitalized(F.col("filename")).alias("capital"),
        S.short_name(F.concat_ws(" of ", "filename", "path")).alias("short"), S.thousands(F.col("author_id") * 12345).alias("thousands"), S.progress(F.col("author_lines"), F.col("total_lines")).alias("progress"),
    )


def threshold_kb_to_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kb = F.when(F.col("p_size") % 5 == 0, None).otherwise(F.col("p_size") / 2)
    return tables.table(spark, sf_dir, "part").select("p_partkey", S.threshold_bytes(kb).alias("threshold_bytes"))


def titles_by_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders by price as developers by lines: their titles, and the titles looked up again by name."""
    by = Window.partitionBy("o_custkey")
    orders = tables.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    place = F.row_number().over(by.orderBy(F.desc("o_totalprice"), "o_orderkey")).cast("long") - 1
    rows = orders.select("o_orderkey", place.alias("place"), F.count(F.lit(1)).over(by).alias("n"))
    title = S.title_at(S.distributed_index(F.col("place"), F.col("n")))
    return rows.select("o_orderkey", "n", "place", title.alias("title"), S.title_index(title).alias("title_index"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, line, hash, commit_ts, record): each line as blame writes it. A file's lines are in the order of the first four: records
    hold their time in decimal, whose order as text is not that of time."""
    rows = tables.lines(spark, sf_dir).join(tables.people(spark, sf_dir), "person").withColumn("hash", F.sha1(F.concat_ws("-", "file_id", "line", "person").cast("binary")))
    record = F.concat("hash", F.format_string(" %d %d 1\nauthor %s\nauthor-mail <%s>\nauthor-time %d\nsummary author fake\n\tauthor ", "line", "line", "name", "email", F.unix_timestamp("commit_ts")), F.col("name"))
    return rows.select("file_id", "line", "hash", "commit_ts", record.alias("record"))


def porcelain_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's lines written as blame output, and read back."""
    texts = _records(spark, sf_dir).groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("line", "hash", "commit_ts", "record"))).alias("all"))
    texts = texts.select(F.concat(F.lit("f"), "file_id").alias("path"), F.array_join("all.record", "\n").alias("porcelain"))
    texts = texts.unionByName(spark.createDataFrame([("literal", LITERAL)], "path string, porcelain string"))
    return porcelain.parse(texts)


def porcelain_parse_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines as files of many orders each, read back from wherever Spark cuts these."""
    out = scratch(spark)
    rows = _records(spark, sf_dir).withColumn("tree", F.floor(F.col("file_id") / 4096))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartition(n, "tree").sortWithinPartitions("tree", "file_id", "line", "hash", "commit_ts").select("tree", "record").write.partitionBy("tree").text(out)
    return porcelain.parse_files(spark, out, F.regexp_extract("_metadata.file_path", "/tree=([0-9]+)/", 1))


def reanalyzed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and their lines after two analyses into one snapshot, the second of which reads only files with lines since the first;
    kept: their lines are still those that the first has written."""
    known, every = tables.files(spark, sf_dir).select("file_id", "path"), tables.lines(spark, sf_dir)
    at = scratch(spark)
    for lines in (every.filter(F.col("commit_ts") < "1995-06-17"), every):
        counts = lines.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"), F.max("commit_ts").alias("last"))
        files = known.join(counts, "file_id", "left").select("file_id", "path", F.concat_ws("@", F.coalesce("n", F.lit(0)), "last").alias("version"))
        snapshot = Snapshot(spark, at, lambda some, lines=lines: some.select("file_id", "path").join(lines, "file_id").select("path", "line", "person"))
        snapshot.refresh(files)
    first = snapshot.versions.latest()[1]["segments"][0]
    totals = snapshot.lines().groupBy("path").agg(F.count(F.lit(1)).alias("total_lines"))
    return snapshot.index().join(totals, "path", "left").select("path", F.coalesce("total_lines", F.lit(0)).alias("total_lines"), (F.col("segment") == first).alias("kept"))


def authors_merged_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authors after lines came in four batches, by year; who has an id keeps it."""
    store = identity.AuthorStore(spark, scratch(spark))
    named = tables.lines(spark, sf_dir).join(tables.people(spark, sf_dir), "person")
    for i, until in enumerate(["", *BATCHES]):
        batch = named.filter((F.col("commit_ts") >= until) if until else F.lit(True)).filter(F.col("commit_ts") < BATCHES[i] if i < len(BATCHES) else F.lit(True))
        store.merge(batch.select("email", "name", F.struct("commit_ts", "file_id", "line").alias("ord")))
    return store.authors()


BATCHES = ("1992-02-01", "1992-03-01", "1994-01-01")


def author_files_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and distinct files of each person, from bitmaps of each half of the years that are stored and then merged."""
    own = tables.lines(spark, sf_dir).select(F.col("person").alias("author_id"), "file_id", "commit_ts")
    early = F.col("commit_ts") < "1995-06-17"
    halves = [identity.stored(ownership.file_bitmaps(own.filter(half))) for half in (early, ~early)]
    return ownership.counts_of_bitmaps(ownership.merged_bitmaps(halves[0].unionByName(halves[1])))


def streamed_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and files by e-mail, after the blame outputs of all files arrived twice in a stream: as they were in mid-1995, and, of
    those that changed since, as they are."""
    every, at = _records(spark, sf_dir).withColumn("path", F.concat(F.lit("t"), F.floor(F.col("file_id") / 64))), scratch(spark)
    made, changed = F.col("commit_ts") < "1995-06-17", spark.createDataFrame([], "path string, email string, lines long, files long")
    schema = "path string, porcelain string, modified timestamp"
    for i, lines in enumerate((every.filter(made), every)):
        texts = lines.groupBy("path").agg(F.array_join(F.array_sort(F.collect_list(F.struct("file_id", "line", "record")))["record"], "\n").alias("porcelain"), F.max("commit_ts").alias("last"))
        if i:
            texts = texts.filter(F.col("last") >= "1995-06-17")
        texts.select("path", "porcelain", F.timestamp_seconds(F.lit(i)).alias("modified")).write.mode("append").parquet(f"{at}/texts")
        arriving = spark.readStream.schema(schema).parquet(f"{at}/texts")
        heard: list[DataFrame] = []
        arrivals.totals(arriving, f"{at}/changes", f"{at}/checkpoint", heard.append).awaitTermination()
        changed = heard[-1] if heard else changed
    return arrivals.by_author(changed)


#: A subject with a tab; content with a carriage return, line separators and next lines; blank content; content like a header.
LITERAL = "\n".join(
    f"{'abcde'[i] * 40} {i + 1} {i + 1} 1\nauthor Jörg\xa0Müller\nauthor-mail <j@x.example>\nauthor-time {86400 * i}\nsummary fix\tbug\tauthor no one\nprevious {'f' * 40} a b\nfilename a b\n\t{content}"
    for i, content in enumerate(["one\r", "two\u2028author three\x85four", " \xa0\r", "\t" + "0" * 40 + " 1 1", "author five"])
)


QUERIES = {f.__name__: f for f in (classify_files, repository_stats, file_line_counts, author_contributions, author_ranking_titles, author_file_contributions, extended_report_top5, developer_report_top15, pie_top10_others, glorious_lowly, authors_upsert, normalize_strict, normalize_loose, author_aliases, all_authors, find_canonical_author, inactive_authors, author_contributions_loose, author_file_contributions_loose, ranked_authors_loose, developers_loose, nth_author, clean_names, nonblank_lines, commit_iso_dates, display_scalars, threshold_kb_to_bytes, titles_by_place, porcelain_parse, porcelain_parse_files, reanalyzed_files, authors_merged_batches, author_files_merged, streamed_contributions)}


def _values(xs) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in xs)


FILES = f"""files0 AS (
  SELECT o_orderkey AS file_id, floor(o_totalprice / 4)::BIGINT AS size0, 'src/' || replace(lower(o_orderpriority), ' ', '') || '/f' || o_orderkey ||
    CASE o_orderkey % 12 {' '.join(f"WHEN {k} THEN '{v}'" for k, v in tables.ENDINGS.items())} ELSE '.ts' END AS path FROM orders),
files1 AS (SELECT *, nullif(lower(regexp_extract(string_split(path, '/')[-1], '^.+([.][^.]*)$', 1)), '') AS extension FROM files0),
files2 AS (SELECT *, coalesce(extension IN ({_values(BINARY_EXTENSIONS)}), false) AS is_binary,
  coalesce(extension IN ({_values(IGNORED_EXTENSIONS)}), false) OR len(list_filter([{_values(IGNORED_NEEDLES)}], lambda x: contains(path, x))) > 0 AS hit FROM files1),
files3 AS (SELECT file_id, path, extension, is_binary, hit AND NOT is_binary AS is_ignored, CASE WHEN is_binary OR hit THEN 0 ELSE size0 END AS size FROM files2),
files AS (SELECT *, size > 51200 AS is_larger_than_threshold FROM files3)"""
PEOPLE = """people AS (SELECT p_partkey % 400 AS person, min(p_name) AS name,
  min(replace(p_name, ' ', '.') || '@' || replace(lower(p_brand), '#', '') || '.example') AS email FROM part GROUP BY 1)"""
BLAME = f"""{FILES}, {PEOPLE},
named AS (SELECT l_orderkey AS file_id, l_linenumber AS line, l_partkey % 400 AS person, name, email FROM lineitem JOIN people ON l_partkey % 400 = person
  JOIN files ON l_orderkey = files.file_id WHERE NOT is_binary AND NOT is_ignored AND NOT is_larger_than_threshold),
firsts AS (SELECT email, min((file_id, line, person, name)) AS f FROM named GROUP BY email),
authors AS (SELECT row_number() OVER (ORDER BY f[1], f[2], f[3], email) AS id, f[4] AS name, email FROM firsts),
blame AS (SELECT id AS author_id, file_id FROM named JOIN authors USING (email)),
totals AS (SELECT file_id, path, is_binary, is_ignored, is_larger_than_threshold, count(b.author_id) AS total_lines FROM files LEFT JOIN blame b USING (file_id) GROUP BY ALL),
counts AS (SELECT a.id, a.name, a.email, count(*) AS total_lines, count(DISTINCT file_id) AS total_files FROM authors a JOIN blame b ON a.id = b.author_id GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (ORDER BY total_lines DESC, id) AS rank, sum(total_lines) OVER () AS everything, count(*) OVER () AS n FROM counts),
shares AS (SELECT *, floor(CAST(total_lines AS DOUBLE) / CAST(everything AS DOUBLE) * 100 * 100 + CAST(0.5 AS DOUBLE)) / 100 AS percentage,
  greatest(1, n // 5) AS fifth FROM ranked),
placed AS (SELECT *, CASE WHEN n = 1 THEN 0 WHEN n = 2 THEN 49 * (rank - 1) WHEN n = 3 THEN [0, 12, 38][rank] WHEN rank - 1 < fifth THEN rank - 1
  WHEN rank - 1 < n - fifth THEN 12 + rank - 1 - fifth ELSE 38 + rank - 1 - (n - fifth) END AS spot FROM shares),
titled AS (SELECT *, CASE WHEN spot BETWEEN 0 AND {len(TITLES) - 1} THEN [{_values(TITLES)}][spot + 1] ELSE 'unknown' END AS title FROM placed),
each0 AS (SELECT author_id, file_id, count(*) AS author_lines FROM blame GROUP BY 1, 2),
each AS (SELECT author_id, string_split(path, '/')[-1] AS filename, path, author_lines, total_lines,
  floor(CAST(author_lines AS DOUBLE) / CAST(total_lines AS DOUBLE) * 100 + CAST(0.5 AS DOUBLE))::BIGINT AS percentage FROM each0 JOIN totals USING (file_id)),
placed_files AS (SELECT *, row_number() OVER (PARTITION BY author_id ORDER BY author_lines DESC, path) AS place FROM each)"""
STRICT = f"""{PEOPLE}, merged AS (SELECT person AS id, name, email, min(person) OVER (PARTITION BY lower(email)) AS canonical_id FROM people)"""
# names of the test tables are two lower-case words; only these rules can tell them apart
SIMILAR = """(a.email = b.email OR a.k = b.k OR contains(a.k, b.k) OR contains(b.k, a.k) OR levenshtein(a.k, b.k) <= least(greatest(floor(greatest(length(a.k), length(b.k)) * CAST(0.4 AS DOUBLE)), 2), 6)
  OR (a.dom = b.dom AND (a.lk = b.lk OR contains(a.lk, b.lk) OR contains(b.lk, a.lk) OR levenshtein(a.lk, b.lk) <= least(greatest(floor(greatest(length(a.lk), length(b.lk)) * CAST(0.15 AS DOUBLE)), 1), 3))))"""
LOOSE = f"""RECURSIVE {PEOPLE},
keys AS (SELECT row_number() OVER (ORDER BY person) AS pos, person AS id, email, regexp_replace(name, '[._0-9-]', '', 'g') AS k,
  regexp_replace(string_split(email, '@')[1], '[._0-9-]', '', 'g') AS lk, string_split(email, '@')[2] AS dom FROM people),
alike AS (SELECT a.pos AS a, b.pos AS b FROM keys a JOIN keys b ON a.pos < b.pos AND {SIMILAR}),
before AS (SELECT k.pos, coalesce(list(s.a) FILTER (WHERE s.a IS NOT NULL), []) AS likes FROM keys k LEFT JOIN alike s ON s.b = k.pos GROUP BY k.pos),
fold AS (SELECT 0::BIGINT AS pos, []::BIGINT[] AS seeds UNION ALL
  SELECT f.pos + 1, CASE WHEN list_has_any(f.seeds, n.likes) THEN f.seeds ELSE list_append(f.seeds, n.pos) END FROM fold f JOIN before n ON n.pos = f.pos + 1),
seeds AS (SELECT unnest(seeds) AS seed FROM fold WHERE pos = (SELECT max(pos) FROM fold)),
claimed AS (SELECT k.id, min(s.seed) AS seed FROM keys k JOIN seeds s ON s.seed = k.pos OR (s.seed < k.pos AND EXISTS (SELECT 1 FROM alike x WHERE x.a = s.seed AND x.b = k.pos))
  GROUP BY k.id)"""

GAP = r"[\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
LETTERS = "translate(md5({0}), '0123456789', 'ghijklmnop')"


def _key(x: str) -> str:
    """SQL of what names and e-mails are compared by."""
    return f"regexp_replace({x}, '[._0-9-]', '', 'g')"


def _like(a: str, b: str, share: float, low: int, high: int) -> str:
    """SQL: two cleaned strings are similar."""
    x, y = _key(a), _key(b)
    return f"({a} <> '' AND {b} <> '' AND ({a} = {b} OR {x} = {y} OR contains({x}, {y}) OR contains({y}, {x}) OR levenshtein({x}, {y}) <= least(greatest(floor(greatest(length({x}), length({y})) * CAST({share} AS DOUBLE)), {low}), {high})))"


TEAMS = f"""RECURSIVE {FILES},
words AS (SELECT DISTINCT p_partkey % 400 AS id, {LETTERS.format("'t' || (p_partkey % 400) // 3")}[1:12] AS w, {LETTERS.format("'m' || p_partkey % 400")}[1:10] AS mail FROM part),
names AS (SELECT id, CASE id % 3 WHEN 1 THEN w || ', Y' WHEN 2 THEN upper(w[1]) || w[2:] || '  jr.' ELSE w END AS name, mail || '@d' || id % 7 || '.example' AS email,
  CASE id % 3 WHEN 1 THEN 'Y ' || w WHEN 2 THEN upper(w[1]) || w[2:] || ' jr.' ELSE w END AS display_name, mail, 'd' || id % 7 || '.example' AS domain FROM words),
shown AS (SELECT *, row_number() OVER (ORDER BY id) AS pos, lower(trim(regexp_replace(regexp_replace(name, '[^a-zA-Z0-9_ ]', '', 'g'), ' +', ' ', 'g'))) AS c1,
  lower(trim(regexp_replace(regexp_replace(display_name, '[^a-zA-Z0-9_ ]', '', 'g'), ' +', ' ', 'g'))) AS c2 FROM names),
alike AS (SELECT a.pos AS a, b.pos AS b FROM shown a JOIN shown b ON a.pos < b.pos AND (a.email = b.email OR
  {' OR '.join(_like(f'a.{p}', f'b.{q}', 0.4, 2, 6) for p in ('c1', 'c2') for q in ('c1', 'c2'))} OR (a.domain = b.domain AND {_like('a.mail', 'b.mail', 0.15, 1, 3)}))),
before AS (SELECT k.pos, coalesce(list(s.a) FILTER (WHERE s.a IS NOT NULL), []) AS likes FROM shown k LEFT JOIN alike s ON s.b = k.pos GROUP BY k.pos),
fold AS (SELECT 0::BIGINT AS pos, []::BIGINT[] AS seeds UNION ALL
  SELECT f.pos + 1, CASE WHEN list_has_any(f.seeds, n.likes) THEN f.seeds ELSE list_append(f.seeds, n.pos) END FROM fold f JOIN before n ON n.pos = f.pos + 1),
seeds AS (SELECT unnest(seeds) AS seed FROM fold WHERE pos = (SELECT max(pos) FROM fold)),
claimed AS (SELECT k.pos, min(s.seed) AS seed FROM shown k JOIN seeds s ON s.seed = k.pos OR EXISTS (SELECT 1 FROM alike x WHERE x.a = s.seed AND x.b = k.pos) GROUP BY k.pos),
readable AS (SELECT s.*, seed, NOT (regexp_full_match(replace(name, ' ', ''), '[A-Za-z0-9+/=]+') OR regexp_matches(name, '[^a-zA-Z0-9_ .-]')
  OR regexp_full_match(replace(display_name, ' ', ''), '[A-Za-z0-9+/=]+') OR regexp_matches(display_name, '[^a-zA-Z0-9_ .-]')) AS ok FROM shown s JOIN claimed USING (pos)),
chosen AS (SELECT *, first_value(id) OVER (PARTITION BY seed ORDER BY ok DESC, CASE WHEN ok THEN -length(display_name) ELSE 0 END, id) AS canonical_id FROM readable),
own AS (SELECT canonical_id AS id, l_orderkey AS file_id FROM lineitem JOIN chosen ON l_partkey % 400 = chosen.id JOIN files ON l_orderkey = files.file_id
  WHERE NOT is_binary AND NOT is_ignored AND NOT is_larger_than_threshold AND (l_partkey % 400) // 3 % 10 <> 0),
counts AS (SELECT id, count(*) AS total_lines, count(DISTINCT file_id) AS total_files FROM own GROUP BY id),
ranked AS (SELECT *, row_number() OVER (ORDER BY total_lines DESC, id) AS rank, sum(total_lines) OVER () AS everything, count(*) OVER () AS n FROM counts),
shares AS (SELECT *, floor(CAST(total_lines AS DOUBLE) / CAST(everything AS DOUBLE) * 100 * 100 + CAST(0.5 AS DOUBLE)) / 100 AS percentage, greatest(1, n // 5) AS fifth FROM ranked),
placed AS (SELECT *, CASE WHEN n = 1 THEN 0 WHEN n = 2 THEN 49 * (rank - 1) WHEN n = 3 THEN [0, 12, 38][rank] WHEN rank - 1 < fifth THEN rank - 1
  WHEN rank - 1 < n - fifth THEN 12 + rank - 1 - fifth ELSE 38 + rank - 1 - (n - fifth) END AS spot FROM shares),
titled AS (SELECT *, CASE WHEN spot BETWEEN 0 AND {len(TITLES) - 1} THEN [{_values(TITLES)}][spot + 1] ELSE 'unknown' END AS title FROM placed)"""

ORACLES = {
    "classify_files": f"WITH {FILES} SELECT * FROM files",
    "repository_stats": f"""WITH {BLAME} SELECT count(*) AS total_files, count(*) FILTER (WHERE NOT is_binary AND NOT is_ignored AND NOT is_larger_than_threshold) AS analyzed_files,
      count(*) FILTER (WHERE is_binary) AS binary_files, count(*) FILTER (WHERE is_ignored AND NOT is_binary) AS ignored_files,
      count(*) FILTER (WHERE is_larger_than_threshold AND NOT is_binary AND NOT is_ignored) AS large_files,
      coalesce(sum(total_lines) FILTER (WHERE NOT is_binary AND NOT is_ignored AND NOT is_larger_than_threshold), 0)::BIGINT AS total_lines, (SELECT count(*) FROM authors) AS total_authors FROM totals""",
    "file_line_counts": f"WITH {BLAME} SELECT file_id, path, total_lines FROM totals",
    "author_contributions": f"WITH {BLAME} SELECT id, name, email, name AS display_name, total_lines, total_files, rank::INT AS rank, percentage FROM shares",
    "author_ranking_titles": f"WITH {BLAME} SELECT a.id, rank::INT AS rank, coalesce(percentage, 0.0::DOUBLE) AS percentage, title FROM authors a LEFT JOIN titled t USING (id)",
    "author_file_contributions": f"WITH {BLAME} SELECT * FROM each",
    "extended_report_top5": f"WITH {BLAME} SELECT * REPLACE (place::INT AS place) FROM placed_files WHERE place <= 5",
    "developer_report_top15": f"WITH {BLAME} SELECT each.* FROM each JOIN ranked ON author_id = id WHERE rank = 1 ORDER BY author_lines DESC, path LIMIT 15",
    "pie_top10_others": f"""WITH {BLAME} SELECT rank::INT AS rank, name AS display_name, percentage, floor(percentage + 0.5::DOUBLE)::BIGINT AS rounded,
      greatest(1, floor(percentage / 100 * 60 + 0.5::DOUBLE)::BIGINT) AS width, greatest(n - 10, 0) AS others FROM shares WHERE rank <= 10""",
    "glorious_lowly": f"""WITH {BLAME} SELECT CASE WHEN rank = 1 THEN 'first' ELSE 'last' END AS place, CASE WHEN length(name) > 30 THEN name[1:27] || '...' ELSE name END AS name,
      upper(title[1]) || title[2:] AS title, floor(percentage + 0.5::DOUBLE)::BIGINT AS percentage FROM titled WHERE rank = 1 OR rank = n""",
    "authors_upsert": f"WITH {BLAME} SELECT id::BIGINT AS id, name, email, name AS display_name FROM authors",
    "normalize_strict": f"WITH {STRICT} SELECT id, canonical_id, id = canonical_id AS is_canonical FROM merged",
    "normalize_loose": f"""WITH {LOOSE}, first AS (SELECT seed, min(id) AS canonical_id FROM claimed GROUP BY seed)
      SELECT id, canonical_id, id = canonical_id AS is_canonical FROM claimed JOIN first USING (seed)""",
    "author_aliases": f"WITH {STRICT} SELECT canonical_id AS canonical_author_id, name AS alias_name, email AS alias_email, 100 AS similarity FROM merged WHERE id <> canonical_id",
    "all_authors": f"""WITH {STRICT} SELECT m.id, m.name, m.email, m.name AS display_name,
      coalesce((SELECT string_agg(o.name, '|' ORDER BY o.name) FROM merged o WHERE o.canonical_id = m.id AND o.id <> m.id), '') AS aliases FROM merged m WHERE m.id = m.canonical_id""",
    "find_canonical_author": f"WITH {BLAME} SELECT e.email, a.id::BIGINT AS canonical_id FROM (SELECT DISTINCT email FROM people UNION ALL SELECT 'nobody@none.example') e LEFT JOIN authors a USING (email)",
    "inactive_authors": f"""WITH {STRICT} SELECT id, email FROM merged WHERE id = canonical_id AND id NOT IN
      (SELECT m.canonical_id FROM lineitem JOIN merged m ON l_partkey % 400 = m.id WHERE l_shipdate < TIMESTAMP '1992-02-01')""",
    "author_contributions_loose": f"""WITH {TEAMS} SELECT id, name, email, display_name, total_lines, total_files, rank::INT AS rank, percentage, title FROM titled JOIN names USING (id)""",
    "author_file_contributions_loose": f"""WITH {TEAMS}, whole AS (SELECT file_id, count(*) AS total_lines FROM own GROUP BY file_id),
      part AS (SELECT id AS author_id, file_id, count(*) AS author_lines FROM own GROUP BY 1, 2)
      SELECT author_id, string_split(path, '/')[-1] AS filename, path, author_lines, total_lines,
      floor(CAST(author_lines AS DOUBLE) / CAST(total_lines AS DOUBLE) * 100 + CAST(0.5 AS DOUBLE))::BIGINT AS percentage FROM part JOIN whole USING (file_id) JOIN files USING (file_id)""",
    "ranked_authors_loose": f"""WITH {TEAMS} SELECT c.id, c.display_name, canonical_id, c.id = canonical_id AS is_canonical, rank::INT AS rank, coalesce(percentage, 0.0::DOUBLE) AS percentage, title
      FROM chosen c LEFT JOIN titled t USING (id)""",
    "developers_loose": f"WITH {TEAMS} SELECT count(*) AS n_developers, (SELECT count(*) FROM names) AS n_authors FROM titled",
    "nth_author": f"WITH {BLAME} SELECT id, name, email, name AS display_name, total_lines, total_files, rank::INT AS rank, percentage, title FROM titled WHERE rank = 3",
    "clean_names": f"""WITH {PEOPLE}, r AS (SELECT person, [{_values(ODD)}][person % {len(ODD)} + 1] AS gap, name || [{_values(ODD)}][person % {len(ODD)} + 1] || 'Müller' AS name FROM people)
      SELECT person, lower(trim(regexp_replace(regexp_replace(name, '[^\\w{GAP[1:-1]}À-ɏ]', '', 'g'), '{GAP}+', ' ', 'g'))) AS clean,
      trim(regexp_replace(CASE WHEN len(string_split(name, ',')) = 2 THEN trim(string_split(name, ',')[2]) || ' ' || trim(string_split(name, ',')[1]) ELSE name END, '{GAP}+', ' ', 'g')) AS display,
      regexp_full_match(regexp_replace(name, '{GAP}', '', 'g'), '[A-Za-z0-9+/=]+') OR regexp_matches(name, '[^\\w{GAP[1:-1]}À-ɏ.-]') AS artifacts, regexp_full_match(gap, '{GAP}*') AS blank FROM r""",
    "nonblank_lines": r"""WITH l AS (SELECT doc_id, unnest(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: NOT regexp_full_match(x, '[\s\p{Z}\x{FEFF}\x0B]*'))) AS content,
      generate_subscripts(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: NOT regexp_full_match(x, '[\s\p{Z}\x{FEFF}\x0B]*')), 1) AS line_number FROM documents)
      SELECT doc_id, line_number::BIGINT AS line_number, sha256(content) AS content_sha256 FROM l""",
    "commit_iso_dates": "SELECT l_orderkey AS file_id, l_linenumber AS line, l_partkey % 400 AS person, strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') || '.000Z' AS commit_date FROM lineitem",
    "display_scalars": f"""WITH {BLAME}, cut AS (SELECT *, regexp_extract(filename, '^(.+)[.][^.]*$', 1) AS b0, regexp_extract(filename, '[.]([^.]*)$', 1) AS e FROM each),
      c2 AS (SELECT *, CASE WHEN b0 = '' THEN filename ELSE b0 END AS b, floor(CAST(percentage AS DOUBLE) / 100 * 15 + 0.5::DOUBLE)::BIGINT AS filled, filename || ' of ' || path AS long_name FROM cut)
      SELECT author_id, path, CASE WHEN length(b) > 12 THEN b[1:12] || '...' ELSE rpad(b, 15, ' ') END AS base, rpad(e, 5, ' ') AS ext, lpad(percentage || '%', 4, ' ') AS share,
      '[' || author_lines || '/' || total_lines || ']' AS ratio, repeat('█', filled) || repeat('░', 15 - filled) AS bar, CASE author_lines WHEN 1 THEN '👑' WHEN 2 THEN '🥈' WHEN 3 THEN '🥉' ELSE '  ' END AS medal,
      upper(filename[1]) || filename[2:] AS capital, CASE WHEN length(long_name) > 30 THEN long_name[1:27] || '...' ELSE long_name END AS short, format('{{:,}}', author_id * 12345) AS thousands,
      least(100, percentage) AS progress FROM c2""",
    "threshold_kb_to_bytes": "SELECT p_partkey, coalesce(CASE WHEN p_size % 5 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) / 2 END, 50.0::DOUBLE) * 1024 AS threshold_bytes FROM part",
    "titles_by_place": f"""WITH g AS (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) - 1 AS place, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
      h AS (SELECT *, greatest(1, n // 5) AS fifth FROM g),
      p AS (SELECT *, CASE WHEN n = 1 THEN 0 WHEN n = 2 THEN 49 * place WHEN n = 3 THEN [0, 12, 38][place + 1] WHEN place < fifth THEN place WHEN place < n - fifth THEN 12 + place - fifth ELSE 38 + place - (n - fifth) END AS spot FROM h)
      SELECT o_orderkey, n, place, CASE WHEN spot < {len(TITLES)} THEN [{_values(TITLES)}][spot + 1] ELSE 'unknown' END AS title, CASE WHEN spot < {len(TITLES)} THEN spot ELSE -1 END::BIGINT AS title_index FROM p""",
    "porcelain_parse_files": f"""WITH {PEOPLE} SELECT (l_orderkey // 4096)::VARCHAR AS path, 'author ' || name AS content, sha1(l_orderkey || '-' || l_linenumber || '-' || l_partkey % 400) AS hash, name, email,
      epoch(l_shipdate)::BIGINT AS epoch, strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') || '.000Z' AS commit_date, (row_number() OVER (PARTITION BY l_orderkey // 4096 ORDER BY l_orderkey, l_linenumber, sha1(l_orderkey || '-' || l_linenumber || '-' || l_partkey % 400), l_shipdate))::INT AS line_number
      FROM lineitem JOIN people ON l_partkey % 400 = person""",
    "reanalyzed_files": f"""WITH {FILES} SELECT path, count(l_orderkey) AS total_lines, count(*) FILTER (WHERE l_shipdate >= TIMESTAMP '1995-06-17') = 0 AS kept FROM files0 LEFT JOIN lineitem ON l_orderkey = file_id GROUP BY path""",
    "author_files_merged": "SELECT l_partkey % 400 AS id, count(*) AS total_lines, count(DISTINCT l_orderkey) AS total_files FROM lineitem GROUP BY 1",
    "streamed_contributions": f"WITH {PEOPLE} SELECT email, count(*) AS total_lines, count(DISTINCT l_orderkey // 64) AS total_files FROM lineitem JOIN people ON l_partkey % 400 = person GROUP BY email",
    "authors_merged_batches": f"""WITH {PEOPLE}, named AS (SELECT email, name, l_shipdate AS t, l_orderkey AS f, l_linenumber AS l,
      {' + '.join(f"(l_shipdate >= TIMESTAMP '{d}')::INT" for d in BATCHES)} AS batch FROM lineitem JOIN people ON l_partkey % 400 = person),
      firsts AS (SELECT email, min((batch, t, f, l, name)) AS x FROM named GROUP BY email)
      SELECT row_number() OVER (ORDER BY x[1], x[2], x[3], x[4], email) AS id, x[5] AS name, email, x[5] AS display_name FROM firsts""",
    "porcelain_parse": f"""WITH {PEOPLE} SELECT 'f' || l_orderkey AS path, 'author ' || name AS content, sha1(l_orderkey || '-' || l_linenumber || '-' || l_partkey % 400) AS hash, name, email,
      epoch(l_shipdate)::BIGINT AS epoch, strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') || '.000Z' AS commit_date, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, sha1(l_orderkey || '-' || l_linenumber || '-' || l_partkey % 400), l_shipdate))::INT AS line_number FROM lineitem JOIN people ON l_partkey % 400 = person
      UNION ALL SELECT 'literal', content, repeat(h, 40), 'Jörg' || chr(160) || 'Müller', 'j@x.example', 86400 * day, strftime(TIMESTAMP '1970-01-01' + to_days(day), '%Y-%m-%dT%H:%M:%S') || '.000Z', n FROM (VALUES
        ('one' || chr(13), 'a', 0, 1), ('two' || chr(8232) || 'author three' || chr(133) || 'four', 'b', 1, 2), (chr(9) || repeat('0', 40) || ' 1 1', 'd', 3, 3), ('author five', 'e', 4, 4)) v(content, h, day, n)""",
}
