"""Further queries: functions over records, sources in tables, sinks as rows, and places in source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeweave.functions import ids, paths, text
from lodeweave.operators import abruns, annotations, graph, imports, locate, normalize, resolve, snapshots
from lodeweave.plans import projections as P
from lodeweave.plans.registry import _EXT, _MOST, _PATH, _busiest, _edges, _paths, query
from lodeweave.sources import sinks, tree
from lodeweave.storage import read, settled

# --- Functions ----------------------------------------------------------------


@query("""SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(' ' || p_name || '|' || p_type || ' |' || p_name || '|  |' || p_brand, '|'), lambda x: trim(x)), lambda x: x <> ''))), ',') AS names FROM part""")
def string_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings trimmed, sorted, without blanks and repeats."""
    raw = F.split(F.concat(F.lit(" "), "p_name", F.lit("|"), "p_type", F.lit(" |"), "p_name", F.lit("|  |"), "p_brand"), r"\|")
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(text.string_set(raw), ",").alias("names"))


@query("""WITH w AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS x, generate_subscripts(string_split(text, ' '), 1) AS i FROM conversations), f AS (SELECT conv_id, turn, x, min(i) AS i FROM w GROUP BY ALL)
SELECT conv_id, turn, string_agg(x, ' ' ORDER BY i) AS words FROM f GROUP BY ALL""")
def first_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of turns, each at its first place."""
    return read(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", F.array_join(text.distinct_in_order(F.split("text", " ")), " ").alias("words"))


@query("""SELECT p_partkey, 'a_' || p_brand || '=' || p_type || CASE WHEN p_size % 2 = 1 THEN ',' || p_name || '=v' ELSE '' END AS aliases FROM part""")
def alias_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases with trimmed names; of names that become equal the first stays."""
    brand = F.concat(F.lit("a_"), "p_brand")
    raw = F.create_map(F.concat(F.lit(" "), brand), F.concat("p_type", F.lit(" ")), brand, F.lit("second"), F.lit(" "), F.col("p_name"), F.col("p_name"), F.when(F.col("p_size") % 2 == 1, " v ").otherwise(" "))
    entries = F.transform(F.map_entries(text.alias_map(raw)), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(entries, ",").alias("aliases"))


_PLACE = "CASE page_id % 6 WHEN 0 THEN ' 12 ' WHEN 1 THEN '0' WHEN 2 THEN '+7' WHEN 3 THEN 'x' WHEN 4 THEN '' ELSE CAST(page_id AS {}) END".format


@query(f"""WITH p AS (SELECT page_id, {_PATH} || ':' || {_PLACE("VARCHAR")} AS s FROM pages), m AS (SELECT page_id, trim(regexp_extract(s, '^(.+):([^:]+)$', 1)) AS file, TRY_CAST(trim(regexp_extract(s, '^(.+):([^:]+)$', 2)) AS INTEGER) AS line FROM p)
SELECT page_id, CASE WHEN file <> '' AND line > 0 THEN file END AS file, CASE WHEN file <> '' AND line > 0 THEN line END AS line FROM m""")
def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places like ``file:line``, parsed."""
    at = text.location(F.concat("path", F.lit(":"), F.expr(_PLACE("string"))))
    return _paths(spark, sf_dir).select("page_id", at.alias("at")).select("page_id", "at.file", "at.line")


@query(f"""WITH p AS (SELECT page_id, {_PATH} AS path FROM pages) SELECT page_id, CASE WHEN page_id % 3 < 2 THEN path END AS file, CASE WHEN page_id % 3 < 2 THEN CAST(page_id % 90 + 1 AS INTEGER) END AS line, CASE WHEN page_id % 3 < 2 THEN CAST(page_id % 7 AS INTEGER) END AS col FROM p""")
def tool_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in a tool's output, with and without a range and a remark; other lines have none."""
    head = F.concat_ws(":", "path", (F.col("page_id") % 90 + 1).cast("string"), (F.col("page_id") % 7).cast("string"))
    line = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("  "), head, F.lit("-19"))).when(F.col("page_id") % 3 == 1, F.concat(head, F.lit(": found here"))).otherwise(F.concat("path", F.lit(" has nothing")))
    return _paths(spark, sf_dir).select("page_id", text.tool_location(line).alias("at")).select("page_id", "at.file", "at.line", F.col("at.column").alias("col"))


@query(f"""WITH {P.SYMBOLS_SQL}, n AS (SELECT file, list_sort(list(DISTINCT name)) AS names FROM symbols GROUP BY file)
SELECT file, array_to_string(names[1:8], ', ') || CASE WHEN len(names) > 8 THEN ', ... (+' || (len(names) - 8) || ' more)' ELSE '' END AS shown FROM n""")
def shortened_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight names of each file, and how many more there are."""
    return P.symbols(spark, sf_dir).groupBy("file").agg(F.collect_set("name").alias("names")).select("file", text.shortened(F.col("names"), 8).alias("shown"))


@query("""SELECT event_id, event_type IN ('click', 'view', 'purchase') AND value >= 20 AND event_id % 5 <> 0 AS ok FROM events""")
def annotation_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether annotations are whole: made of events, some without a text or with an unknown confidence."""
    level = F.when(F.col("event_type") == "click", "low").when(F.col("event_type") == "view", "medium").when(F.col("event_type") == "purchase", "high").when(F.col("event_type") == "error", None).otherwise("sure")
    some = F.when(F.col("value") < 20, " ").otherwise("text")
    purpose = F.when(F.col("event_id") % 5 == 0, F.when(F.col("event_id") % 2 == 0, "")).otherwise("why")
    return read(spark, sf_dir, "events").select("event_id", annotations.valid(some, purpose, F.lit("none"), level).alias("ok"))


@query(f"""WITH {P.SYMBOLS_SQL} SELECT id, CASE WHEN line % 3 = 0 THEN 'given' ELSE file || '|' || line || '|' || kind || '|' || name || CASE WHEN line % 2 = 0 THEN '|' || substr(sha1(signature), 1, 8) ELSE '' END END AS sid FROM symbols""")
def filled_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids, made where they are missing or empty."""
    given = F.when(F.col("line") % 3 == 0, "given").when(F.col("line") % 3 == 1, "")
    signature = F.when(F.col("line") % 2 == 0, F.col("signature"))
    return P.symbols(spark, sf_dir).select("id", ids.filled_id(given, F.col("file"), F.col("line"), F.col("kind"), F.col("name"), signature).alias("sid"))


@query("""SELECT p_partkey, coalesce(['func', 'method', 'class', 'struct', 'interface', 'module', 'const', 'var'][p_size % 12 + 1], 'unknown') AS kind FROM part""")
def kind_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of kinds by number."""
    return read(spark, sf_dir, "part").select("p_partkey", ids.kind_text((F.col("p_size") % 12).cast("int")).alias("kind"))


_SERVED = "CASE WHEN ext = '.go' THEN 'go' WHEN ext = '.py' THEN 'python' WHEN ext = '.rb' THEN 'ruby' WHEN ext IN ('.ts', '.tsx') THEN 'typescript' WHEN ext IN ('.js', '.jsx', '.mjs', '.cjs') THEN 'javascript' END"
_FILES_SQL = f"p AS (SELECT page_id, {_PATH} || {_EXT} AS path FROM pages), e AS (SELECT *, lower(regexp_extract(path, '(\\.[^./]*)$', 1)) AS ext FROM p)"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).select("page_id", F.concat(F.col("path"), F.expr(_EXT)).alias("path"))


@query(f"WITH {_FILES_SQL} SELECT page_id, {_SERVED} AS language FROM e")
def served_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of which a server may be asked about a path."""
    return _files(spark, sf_dir).select("page_id", paths.served_language(F.col("path")).alias("language"))


@query(f"WITH {_FILES_SQL}, s AS (SELECT {_SERVED} AS l FROM e) SELECT " + ", ".join(f"coalesce(bool_or(l = '{n}'), false) AS {n}" for n in ("go", "python", "ruby", "typescript", "javascript")) + " FROM s")
def language_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which languages there are."""
    from lodeweave.plans.engine import present_languages

    return present_languages(_files(spark, sf_dir))


@query(f"WITH {_FILES_SQL} SELECT page_id, path FROM e WHERE ext IN ('.py', '.pyw', '.go')")
def language_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of two languages, by their short and long names."""
    wanted = paths.language_set(["PY", " go "])
    return _files(spark, sf_dir).where(paths.language_of(F.col("path")).isin(wanted))


@query(f"WITH p AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'vendor/' WHEN 1 THEN 'a/vendor/' WHEN 2 THEN 'dist/' WHEN 3 THEN 'distant/' ELSE 'node_modules/' END || {_PATH} AS path FROM pages) SELECT page_id, path FROM p WHERE page_id % 5 IN (0, 2, 4)")
def suspicious_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in folders of others' code."""
    head = F.expr("CASE page_id % 5 WHEN 0 THEN 'vendor/' WHEN 1 THEN 'a/vendor/' WHEN 2 THEN 'dist/' WHEN 3 THEN 'distant/' ELSE 'node_modules/' END")
    return _paths(spark, sf_dir).select("page_id", F.concat(head, F.col("path")).alias("path")).where(paths.suspicious(F.col("path")))


@query("""SELECT p_partkey, unnest(CASE p_size % 4 WHEN 0 THEN [p_name, p_type] WHEN 1 THEN [p_brand] ELSE [] END) AS name, CAST(CASE WHEN p_size % 4 = 1 THEN p_size ELSE 0 END AS INTEGER) AS line FROM part""")
def decoded_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls in the JSON of older and newer files."""
    old = F.concat(F.lit('["'), "p_name", F.lit('", "'), "p_type", F.lit('"]'))
    new = F.concat(F.lit(' [{"name": "'), "p_brand", F.lit('", "line": '), "p_size", F.lit("}]"))
    json = F.when(F.col("p_size") % 4 == 0, old).when(F.col("p_size") % 4 == 1, new).when(F.col("p_size") % 4 == 2, "")
    return read(spark, sf_dir, "part").select("p_partkey", F.explode(normalize.decoded_calls(json)).alias("c")).select("p_partkey", "c.name", "c.line")


# --- Runs ---------------------------------------------------------------------


@query("""SELECT o_orderkey AS run_id, CASE o_orderkey % 3 WHEN 0 THEN 'total_cost' ELSE 'input_tokens' END AS label, CASE o_orderkey % 3 WHEN 0 THEN o_orderkey + 1000.5 ELSE o_orderkey END::DOUBLE AS value FROM orders WHERE o_orderkey % 3 < 2""")
def scraped_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers from lines of a statistics table; other lines are left out."""
    key = F.col("o_orderkey")
    cost = F.concat(F.lit("│Total Cost   $"), F.format_number(key + 1000.5, 1), F.lit(" │"))
    line = F.when(key % 3 == 0, cost).when(key % 3 == 1, F.concat(F.lit("Input Tokens: "), key)).otherwise("nothing here")
    return abruns.scraped(read(spark, sf_dir, "orders").select(key.alias("run_id"), line.alias("line")))


@query("""SELECT user_id AS run_id, count(*) FILTER (WHERE event_type = 'view') AS step_count, count(*) FILTER (WHERE event_type IN ('click', 'purchase', 'signup')) AS tool_call_count, count(*) FILTER (WHERE event_type = 'signup') AS task_tool_call_count,
count(*) FILTER (WHERE event_type = 'click' AND event_id % 3 = 0) AS doctor_count, count(*) FILTER (WHERE event_type = 'click' AND event_id % 3 = 1) AS update_count, count(*) FILTER (WHERE event_type = 'purchase') AS symbol_count FROM events GROUP BY user_id""")
def counted_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps, tools and commands of runs, from their events as JSON; some lines are broken."""
    tool = lambda name, command: F.concat(F.lit('{"type":"tool_use","part":{"tool":"' + name + '","state":{"input":{"command":"'), command, F.lit('"}}}}'))
    kind = F.col("event_type")
    click = F.when(F.col("event_id") % 3 == 0, "x doctor").when(F.col("event_id") % 3 == 1, "x update --json").otherwise("doctors")
    json = F.when(kind == "view", '{"type":"step_start"}').when(kind == "click", tool("bash", click)).when(kind == "purchase", tool("bash", F.lit("symbol y"))).when(kind == "signup", tool("task", F.lit("z"))).otherwise("{broken")
    return abruns.event_counts(read(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), json.alias("json")))


@query("""WITH m AS (SELECT o_custkey AS run_id, o_orderkey AS k FROM orders), v AS (SELECT run_id, 'total_cost_usd' AS label, k + 0.5 AS value FROM m UNION ALL SELECT run_id, 'input_tokens', k % 10 FROM m WHERE k % 2 = 0 UNION ALL SELECT run_id, 'total_cost_usd', 1 FROM m WHERE k % 2 = 0 UNION ALL SELECT run_id, 'cache_read_tokens', 7 FROM m WHERE k % 2 = 1)
SELECT run_id, label, sum(value)::DOUBLE AS value FROM v GROUP BY ALL""")
def summed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs and tokens of sessions' messages, summed by run; half of the records hold a list of messages, half are one."""
    key = F.col("o_orderkey")
    many = F.format_string('{"messages":[{"cost":%s,"tokens":{"input":%s}},{"cost":1}]}', (key + 0.5).cast("string"), (key % 10).cast("string"))
    one = F.format_string('{"cost":%s,"tokens":{"cache":{"read":7}}}', (key + 0.5).cast("string"))
    return abruns.session_sums(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id"), F.when(key % 2 == 0, many).otherwise(one).alias("json")))


@query("""WITH s AS (SELECT o_orderkey AS run_id, 'cost' AS label, o_orderkey + 0.5 AS a FROM orders WHERE o_orderkey % 2 = 0), t AS (SELECT o_orderkey AS run_id, 'cost' AS label, o_orderkey + 9.0 AS b FROM orders WHERE o_orderkey % 3 = 0) SELECT run_id, label, coalesce(a, b)::DOUBLE AS value FROM s FULL JOIN t USING (run_id, label)""")
def preferred_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of sessions, and those of statistics lines where sessions say nothing."""
    key = F.col("o_orderkey")
    figures = lambda by, more: read(spark, sf_dir, "orders").where(key % by == 0).select(key.alias("run_id"), F.lit("cost").alias("label"), (key + more).cast("double").alias("value"))
    statistics = figures(3, 9.0).unionByName(figures(3, 8.0))
    return abruns.preferred(figures(2, 0.5), statistics)


@query("""SELECT o_orderkey AS run_id, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN o_orderkey + 0.5 WHEN 2 THEN NULL ELSE o_orderkey END::DOUBLE AS input_tokens, o_custkey::DOUBLE AS step_count FROM orders""")
def normalized_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs whose measures were text."""
    key = F.col("o_orderkey")
    raw = F.when(key % 4 == 0, " ").when(key % 4 == 1, F.concat(F.lit(" "), (key + 0.5).cast("string"), F.lit(" "))).when(key % 4 == 2, "many").otherwise(key.cast("string"))
    return abruns.normalized(read(spark, sf_dir, "orders").select(key.alias("run_id"), raw.alias("input_tokens"), F.col("o_custkey").cast("double").alias("step_count")))


# --- Sources in tables ---------------------------------------------------------

_NAME = "'Fn_' || p_partkey"


def _sources(spark: SparkSession, sf_dir: str, extension: str, body: str) -> DataFrame:
    """Return a source file for each part: of ``body`` with the part's number and its size in place of N and S."""
    content = F.replace(F.replace(F.lit(body), F.lit("N"), F.col("p_partkey").cast("string")), F.lit("S"), F.col("p_size").cast("string"))
    return tree.parsed_table(read(spark, sf_dir, "part").select(F.concat(F.lit("pkg/f"), "p_partkey", F.lit(extension)).alias("path"), content.alias("content")))


def _extracted(files: DataFrame) -> DataFrame:
    return files.select("path", "language", F.explode("symbols").alias("s")).select("path", "language", "s.name", "s.kind", "s.line", F.array_join(F.transform("s.calls", lambda c: c["name"]), ",").alias("calls"))


def _extract_sql(extension: str, language: str, rows: list[tuple[str, str, int, str]]) -> str:
    one = "SELECT 'pkg/f' || p_partkey || '{}' AS path, '{}' AS language, {} AS name, '{}' AS kind, CAST({} AS INTEGER) AS line, {} AS calls FROM part".format
    return " UNION ALL ".join(one(extension, language, name, kind, line, calls) for name, kind, line, calls in rows)


@query(_extract_sql(".go", "go", [("'fn_' || p_partkey", "func", 3, "'helper_' || p_size || ',other'"), ("'helper_' || p_size", "func", 8, "''")]))
def extracted_go(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions and calls of Go files that lie in a table."""
    return _extracted(_sources(spark, sf_dir, ".go", "package p\n\nfunc fn_N() {\n\thelper_S()\n\tother()\n}\n\nfunc helper_S() {}\n"))


@query(_extract_sql(".py", "python", [("'C_' || p_partkey", "class", 1, "''"), ("'run'", "method", 2, "'helper_' || p_size"), ("'helper_' || p_size", "func", 5, "''")]))
def extracted_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes, methods, functions and calls of Python files that lie in a table."""
    return _extracted(_sources(spark, sf_dir, ".py", "class C_N:\n    def run(self):\n        helper_S()\n\ndef helper_S():\n    pass\n"))


@query(_extract_sql(".rb", "ruby", [("'M_' || p_partkey", "module", 1, "''"), ("'run'", "func", 2, "'helper_' || p_size"), ("'helper_' || p_size", "func", 7, "''")]))
def extracted_ruby(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules, methods and calls of Ruby files that lie in a table."""
    return _extracted(_sources(spark, sf_dir, ".rb", "module M_N\n  def run\n    helper_S()\n  end\nend\n\ndef helper_S\nend\n"))


@query(_extract_sql(".ts", "typescript", [("'fn_' || p_partkey", "func", 1, "'helper_' || p_size"), ("'helper_' || p_size", "func", 5, "''")]))
def extracted_typescript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions and calls of TypeScript files that lie in a table."""
    return _extracted(_sources(spark, sf_dir, ".ts", "function fn_N() {\n  helper_S();\n}\n\nfunction helper_S() {}\n"))


# --- Places in source, snapshots, records ----------------------------------------


@query(f"""WITH p AS (SELECT DISTINCT {_PATH} AS path FROM pages), f AS (SELECT path, regexp_extract(path, '[^/]*$') AS base, contains(path, '/') AS deep FROM p),
k AS (SELECT path, regexp_replace(path, '\\.[^./]*$', '') AS stem, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS dir, regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^./]*$', '') AS bare FROM p),
i AS (SELECT path AS file, base AS alias, 'lib/' || path AS q, NULL AS sym FROM f WHERE base <> '' UNION ALL SELECT path, 'near', 'lib/' || path, 'Sym' FROM f WHERE deep)
SELECT DISTINCT file, alias, k.path AS target_file, sym AS target_name FROM i, k WHERE q = stem OR q = dir OR q = bare OR ends_with(q, '/' || stem) OR ends_with(q, '/' || dir) OR ends_with(q, '/' || bare)""")
def alias_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What aliases of imports mean: those that files give, and imports' last components."""
    far = F.concat(F.lit("lib/"), "path")
    files = _paths(spark, sf_dir).select("path").distinct().select("path", F.array(far).alias("imports"), F.when(F.contains("path", F.lit("/")), F.create_map(F.lit("near"), F.concat(far, F.lit("#Sym")))).otherwise(F.create_map().cast("map<string,string>")).alias("import_aliases"))
    return imports.aliases(files).distinct()


_LOCATIONS = "places AS (SELECT l_orderkey * 10 + l_linenumber AS pos, s.file, CAST(s.line + l_quantity AS INTEGER) AS line FROM lineitem JOIN symbols s ON s.id = CAST(l_partkey AS VARCHAR) WHERE l_orderkey % 50 = 7)"


def _locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = P.symbols(spark, sf_dir).select(F.col("line").cast("long").alias("l_partkey"), "file", "line")
    return read(spark, sf_dir, "lineitem").where("l_orderkey % 50 = 7").join(known, "l_partkey").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), "file", (F.col("line") + F.col("l_quantity")).cast("int").alias("line"))


@query(f"""WITH {P.EDGES_SQL}, q AS ({_MOST}), {_LOCATIONS}, hit AS (SELECT DISTINCT s.id FROM (SELECT DISTINCT file, line FROM places) p ASOF JOIN symbols s ON p.file = s.file AND p.line >= s.line)
SELECT hit.id, coalesce(e.confidence, '') AS confidence FROM hit LEFT JOIN edges e ON e.src = hit.id AND e.dst = (SELECT id FROM q) WHERE hit.id <> (SELECT id FROM q)""")
def tool_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symbols in which the places that a tool names lie, with the confidence of an edge to the one asked for."""
    edges = settled(_edges(spark, sf_dir), "edges")
    own = _busiest(edges).first()
    return locate.references(_locations(spark, sf_dir), P.symbols(spark, sf_dir), own[0] if own else "", edges)


@query(f"""WITH {P.SYMBOLS_SQL}, {_LOCATIONS} SELECT s.id FROM places p ASOF JOIN symbols s ON p.file = s.file AND p.line >= s.line ORDER BY p.pos, s.id LIMIT 1""")
def tool_definition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symbol of the first place that lies in one."""
    return locate.definition(_locations(spark, sf_dir), P.symbols(spark, sf_dir))


@query(f"""WITH {P.SYMBOLS_SQL}, {_LOCATIONS}, d AS (SELECT DISTINCT file, line, pos % 7 AS col FROM places) SELECT file, line, col, row_number() OVER (ORDER BY file, line, col) AS place FROM d""")
def sorted_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places without repeats, numbered in order of file, line and column."""
    once = _locations(spark, sf_dir).select("file", "line", (F.col("pos") % 7).alias("col")).distinct()
    return once.withColumn("place", F.row_number().over(Window.orderBy("file", "line", "col")).cast("long"))  # the order of one answer


@query(f"WITH {P.SYMBOLS_SQL} SELECT id, name, file, line, row_number() OVER (ORDER BY id) AS place FROM symbols WHERE name = (SELECT min(name) FROM symbols) ORDER BY id LIMIT 10")
def symbol_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten symbols of a name, in order of id."""
    from lodeweave.plans.engine import exact

    known = P.symbols(spark, sf_dir)
    name = known.agg(F.min("name")).first()[0]
    return exact(known, name).orderBy("id").limit(10).select("id", "name", "file", "line", F.row_number().over(Window.orderBy("id")).cast("long").alias("place"))


@query(f"""WITH RECURSIVE {P.EDGES_SQL}, q AS ({_MOST}), walk AS (SELECT id, 0 AS depth FROM q UNION SELECT e.dst, depth + 1 FROM walk JOIN edges e ON e.src = walk.id WHERE depth < 1), near AS (SELECT id, min(depth) AS depth FROM walk GROUP BY id)
SELECT e.src, e.dst, CAST(n.depth + 1 AS INTEGER) AS depth, 'parser' AS source, row_number() OVER (ORDER BY n.depth, e.src, e.dst) AS place FROM edges e JOIN near n ON n.id = e.src""")
def ordered_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls up to two steps from a symbol with their origin, numbered in order of depth and ids."""
    edges = settled(_edges(spark, sf_dir), "edges")
    hops = graph.trace(edges, _busiest(edges), 2)
    return hops.select("src", "dst", "depth", F.lit("parser").alias("source"), F.row_number().over(Window.orderBy("depth", "src", "dst")).cast("long").alias("place"))  # the order of one answer


@query(f"""WITH {P.SNAPSHOTS_SQL} SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'deleted' WHEN a.path IS NULL THEN 'added' ELSE 'changed' END AS change FROM old a FULL JOIN cur b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.hash <> b.hash OR a.deps[1] = '1997'""")
def stale_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes between snapshots together with rows of an older form, which count as changed."""
    old, new = P.snapshots(spark, sf_dir)
    return snapshots.difference(old, new, F.get("deps", F.lit(0)) == "1997")


@query(f"""WITH {P.GEOGRAPHY_SQL}, n AS (SELECT 's' || s_suppkey AS src_file, 'n' || (s_nationkey + k) % 25 AS dst_file FROM supplier, range(2) r(k)), own AS (SELECT src_file, string_agg(DISTINCT dst_file, ',' ORDER BY dst_file) AS deps FROM n GROUP BY src_file)
SELECT path, CASE WHEN starts_with(path, 's') THEN own.deps WHEN path = 'r1' THEN '' ELSE array_to_string(snap.deps, ',') END AS deps FROM snap LEFT JOIN own ON own.src_file = path""")
def refreshed_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot in which some files have other dependencies."""
    suppliers = read(spark, sf_dir, "supplier")
    path = F.concat(F.lit("s"), "s_suppkey")
    found = suppliers.select(path.alias("src_file"), F.explode(F.array(F.lit(0), F.lit(1))).alias("k"), "s_nationkey").select("src_file", F.concat(F.lit("n"), (F.col("s_nationkey") + F.col("k")) % 25).alias("dst_file"))
    some = suppliers.select(path.alias("path")).unionByName(spark.range(1).select(F.lit("r1").alias("path")))
    return snapshots.refreshed(P.geography(spark, sf_dir), found, some).select("path", F.array_join("deps", ",").alias("deps"))


@query(f"""WITH {P.EDGES_SQL}, o AS (SELECT src AS id, string_agg(dst, ',' ORDER BY dst) AS t FROM edges GROUP BY src), i AS (SELECT dst AS id, string_agg(src, ',' ORDER BY src) AS t FROM edges GROUP BY dst)
SELECT s.id AS symbol_id, 'h_' || s.file AS file_hash, 'pending' AS status, s.name, CASE WHEN s.line BETWEEN 1 AND 60 THEN 'l' || s.line ELSE '' END AS body, 'fmt' AS imports, coalesce(o.t, '') AS calls, coalesce(i.t, '') AS called_by FROM symbols s LEFT JOIN o ON o.id = s.id LEFT JOIN i ON i.id = s.id""")
def annotation_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What there is to say about each symbol."""
    known = P.symbols(spark, sf_dir)
    content = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda k: F.concat(F.lit("  l"), k.cast("string"), F.lit(" "))), "\n")
    files = known.select(F.col("file").alias("path")).distinct().select("path", F.lit("go").alias("language"), F.concat(F.lit("h_"), "path").alias("hash"), F.array(F.lit("fmt")).alias("imports"), content.alias("content"))
    made = annotations.records(known, files, settled(_edges(spark, sf_dir), "edges"))
    joined = lambda c: F.array_join(F.col(f"input.{c}"), ",").alias(c)
    return made.select("symbol_id", "file_hash", "status", "input.symbol.name", "input.source.body", joined("imports"), joined("calls"), joined("called_by"))


# --- Sinks as rows ---------------------------------------------------------------


@query(f"""WITH {P.SYMBOLS_SQL} SELECT id, '{{"id":"' || id || '","name":"' || name || '","kind":"' || kind || '","signature":"' || signature || '","file":"' || file || '","language":"' || CASE WHEN starts_with(file, 'Brand#1') THEN 'go' ELSE '' END || '","line":' || line || CASE WHEN line % 2 = 0 THEN ',"doc":"' || doc || '"' ELSE '' END || '}}' AS json FROM symbols""")
def symbol_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols as JSON; an empty doc has no field."""
    known = P.symbols(spark, sf_dir).withColumn("doc", F.when(F.col("line") % 2 == 0, F.col("doc")).otherwise(""))
    files = known.select(F.col("file").alias("path")).distinct().withColumn("language", F.when(F.startswith("path", F.lit("Brand#1")), "go"))
    return sinks.symbol_json(known, files).select("id", "json")


@query(f"""WITH {P.EDGES_SQL} SELECT src AS id, dst, '{{"source_id":"' || src || '","target_id":"' || dst || '","confidence":"' || confidence || '"}}' AS json FROM edges""")
def edge_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges as JSON."""
    return sinks.edge_json(P.symbols(spark, sf_dir), _edges(spark, sf_dir)).select("id", "dst", "json")


@query(f"""WITH {P.SYMBOLS_SQL}, top AS (SELECT * FROM symbols ORDER BY line % 17 DESC, id LIMIT 20) SELECT 0 AS part, '- ' || id || ' [' || kind || '] ' || signature AS text FROM top UNION ALL SELECT 1, '- ' || file || ' (' || count(*) || ' symbols)' FROM symbols GROUP BY file""")
def overview_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the overview: the first symbols by a given rank, and all files."""
    known = P.symbols(spark, sf_dir)
    return sinks.index_lines(known, known.select("id", (F.col("line") % 17).cast("double").alias("rank"))).select("part", "text")


@query(f"""WITH {P.EDGES_SQL}, o AS (SELECT src AS id, string_agg('"' || dst || '"', ',' ORDER BY dst) AS t, string_agg('{{"target_id":"' || dst || '","confidence":"' || confidence || '"}}', ',' ORDER BY dst) AS c FROM edges GROUP BY src), i AS (SELECT dst AS id, string_agg('"' || src || '"', ',' ORDER BY src) AS t FROM edges GROUP BY dst)
SELECT s.id, '{{"id":"' || s.id || '","name":"' || name || '","kind":"' || kind || '","signature":"' || signature || '","file":"' || file || '","line":' || line || ',"out_edges":[' || coalesce(o.t, '') || '],"in_edges":[' || coalesce(i.t, '') || '],"out_confidence":[' || coalesce(o.c, '') || ']}}' AS json FROM symbols s LEFT JOIN o ON o.id = s.id LEFT JOIN i ON i.id = s.id""")
def navigation_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the navigation index as JSON."""
    return sinks.navigation_json(P.symbols(spark, sf_dir), settled(_edges(spark, sf_dir), "edges")).select("id", "json")


@query(f"""WITH {P.SYMBOLS_SQL}, t AS (SELECT id, term, sum(w) AS tf FROM (SELECT id, unnest(regexp_extract_all(lower(name), '[a-z0-9_]+')) AS term, 4 AS w FROM symbols UNION ALL SELECT id, unnest(regexp_extract_all(lower(signature), '[a-z0-9_]+')), 2 FROM symbols UNION ALL SELECT id, unnest(regexp_extract_all(lower(file), '[a-z0-9_]+')), 2 FROM symbols UNION ALL SELECT id, unnest(regexp_extract_all(lower(doc), '[a-z0-9_]+')), 1 FROM symbols) GROUP BY ALL),
m AS (SELECT id, sum(tf) AS length, string_agg('"' || term || '":' || tf, ',' ORDER BY term) AS terms FROM t GROUP BY id)
SELECT id, '{{"id":"' || id || '","name":"' || name || '","kind":"' || kind || '","signature":"' || signature || '","file":"' || file || '","line":' || line || ',"doc":"' || doc || '","length":' || length || ',"terms":{{' || terms || '}}}}' AS json FROM symbols JOIN m USING (id)""")
def search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the search index as JSON."""
    from lodeweave.operators import search

    known = P.symbols(spark, sf_dir)
    return sinks.search_json(known, search.build(known).postings).select("id", "json")
