"""DuckDB SQL that computes the same results as the registered queries.

Every statement is built from the same chain of common table expressions:
words -> vocabulary -> encoded tokens -> first topics -> sweeps.
"""

from __future__ import annotations

# Parameters of the registered queries.
K = 5
SEED = 42
ALPHA, BETA = 0.3, 0.5
EDGE_ALPHA, EDGE_BETA = 1.3, 1.5
# Numbers of topics of the sweeps with many of them.
MANY = (24, 64)

# Constants of the public xxHash64 algorithm, which Spark's
# xxhash64 function follows, and the seed that function starts from.
P1 = 0x9E3779B185EBCA87
P2 = 0xC2B2AE3D27D4EB4F
P3 = 0x165667B19E3779F9
P4 = 0x85EBCA77C2B2AE63
P5 = 0x27D4EB2F165667C5
START = 42
MASK = (1 << 64) - 1


def hash_step(value: int, seed: int) -> int:
    """xxHash64 of one 64-bit number."""
    lane = value * P2 & MASK
    lane = (lane << 31 | lane >> 33) & MASK
    h = (seed + P5 + 8 & MASK) ^ lane * P1 & MASK
    h = ((h << 27 | h >> 37) & MASK) * P1 + P4 & MASK
    h = (h ^ h >> 33) * P2 & MASK
    h = (h ^ h >> 29) * P3 & MASK
    return h ^ h >> 32


def number(value: int) -> str:
    return f"{value}::UHUGEINT"


def wrap(expression: str) -> str:
    return f"(({expression}) & {number(MASK)})"


def hash_columns(value: str, seed: str, tag: str) -> list[tuple[str, str]]:
    """The same step as columns (name, expression); the last one is the hash."""

    def rotate(column: str, bits: int) -> str:
        low = wrap(f"{column} * {number(1 << bits)}")
        return f"({low} | ({column} >> {64 - bits}))"

    a, b, c, d, e, f, g = (f"{letter}{tag}" for letter in "abcdefg")
    return [
        (a, wrap(f"{value}::UHUGEINT * {number(P2)}")),
        (b, wrap(f"{rotate(a, 31)} * {number(P1)}")),
        (c, f"xor({wrap(f'{seed} + {number((P5 + 8) & MASK)}')}, {b})"),
        (d, wrap(f"{rotate(c, 27)} * {number(P1)} + {number(P4)}")),
        (e, wrap(f"xor({d}, {d} >> 33) * {number(P2)}")),
        (f, wrap(f"xor({e}, {e} >> 29) * {number(P3)}")),
        (g, f"xor({f}, {f} >> 32)"),
    ]


def with_uniform(source: str, iteration: int, seed: int = SEED) -> str:
    """SELECT of all columns of ``source`` and the uniform number u of each token."""
    key = hash_step(iteration, hash_step(seed, START))
    columns = hash_columns("doc_id", number(hash_step(key, START)), "_doc")
    before = number(START)
    for tag, name in (("key", columns[-1][0]), ("term", "term_id"), ("pos", "pos")):
        columns += hash_columns(name, before, f"_{tag}")
        before = columns[-1][0]
    # One level per step: an alias used twice in its own SELECT would be
    # expanded twice, and so on through all the steps.
    nested = source
    for name, expression in columns:
        nested = f"(SELECT *, {expression} AS {name} FROM {nested})"
    hidden = ", ".join(name for name, _ in columns)
    return (
        f"SELECT * EXCLUDE ({hidden}), ({before}::UBIGINT >> 11)::DOUBLE / 9007199254740992::DOUBLE AS u"
        f" FROM {nested}"
    )


def chain(*parts: str) -> str:
    return "WITH " + ",\n".join(parts)


WORDS = r"""tok AS MATERIALIZED (
  SELECT doc_id, unnest(range(len(w)))::INT AS pos, unnest(w) AS term FROM (
    SELECT doc_id, list_filter(string_split_regex(lower(text), '\s+'),
                               lambda x: length(x) > 0) AS w FROM documents))"""

VOCAB = """vocab AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY n_tokens DESC, term) - 1 AS term_id,
         term, n_tokens, n_docs
  FROM (SELECT term, count(*) AS n_tokens, count(DISTINCT doc_id) AS n_docs
        FROM tok GROUP BY term))"""

ENCODED = """enc AS MATERIALIZED (
  SELECT doc_id, pos, term_id FROM tok JOIN vocab USING (term))"""


def first_topics(k: int = K) -> str:
    return f"""t0 AS MATERIALIZED (
  SELECT doc_id, pos, term_id, floor(u * {k}::DOUBLE)::INT AS topic
  FROM ({with_uniform('enc', 0)}))"""


FIRST = first_topics()

CORPUS = [WORDS, VOCAB, ENCODED]
START_STATE = [*CORPUS, FIRST]


def counts(state: str, key: str, prefix: str, topics: int = K) -> str:
    columns = ", ".join(
        f"count(*) FILTER (topic = {k}) AS {prefix}{k}" for k in range(topics)
    )
    return f"SELECT {key}{', ' if key else ''}{columns} FROM {state}{' GROUP BY ' + key if key else ''}"


def tables(state: str, tag: str, topics: int = K) -> list[str]:
    """Counts of a state by term, by document, by (document, term), and in total."""
    return [
        f"w{tag} AS MATERIALIZED ({counts(state, 'term_id', 'w', topics)})",
        f"d{tag} AS MATERIALIZED ({counts(state, 'doc_id', 'd', topics)})",
        f"c{tag} AS MATERIALIZED (SELECT *, {plus('n', topics)} AS cnt FROM ({counts(state, 'doc_id, term_id', 'n', topics)}))",
        f"s{tag} AS MATERIALIZED ({counts(state, '', 's', topics)})",
        f"v{tag} AS MATERIALIZED (SELECT count(*)::DOUBLE AS vocab_size FROM vocab)",
    ]


def plus(prefix: str, topics: int = K) -> str:
    return " + ".join(f"{prefix}{k}" for k in range(topics))


def collapsed_terms(k: int) -> str:
    e = f"(CASE WHEN topic = {k} THEN 1 ELSE 0 END)"
    return (
        f"(w{k} - {e} + {BETA}::DOUBLE) / (s{k} - {e} + vocab_size * {BETA}::DOUBLE)"
        f" * (d{k} - {e} + {ALPHA}::DOUBLE)"
    )


def edge_terms(k: int) -> str:
    return (
        f"(n{k} - 1 + {EDGE_BETA}::DOUBLE) * ((d{k} - 1 + {EDGE_ALPHA}::DOUBLE)"
        f" / (s{k} - 1 + vocab_size * {EDGE_BETA}::DOUBLE))"
    )


def choose(source: str, topics: int = K) -> str:
    """Draw from weights p0 .. with the uniform u: smallest topic above the mark."""
    sums = ["p0 AS c0"]
    for k in range(1, topics):
        sums.append(f"c{k - 1} + p{k} AS c{k}")
    last = topics - 1
    cases = " ".join(f"WHEN c{k} > u * c{last} THEN {k}" for k in range(last))
    return (
        f"SELECT doc_id, pos, term_id, was, (CASE {cases} ELSE {last} END)::INT AS topic"
        f" FROM (SELECT *, {', '.join(sums)} FROM {source})"
    )


def sweep(number_: int, topics: int = K) -> list[str]:
    """CTEs of collapsed sweep number 1, 2, ..."""
    before, after = f"t{number_ - 1}", f"t{number_}"
    tag = f"_{number_ - 1}"
    weights = ", ".join(f"{collapsed_terms(k)} AS p{k}" for k in range(topics))
    return [
        *tables(before, tag, topics),
        f"p{tag} AS (SELECT doc_id, pos, term_id, topic AS was, u, {weights} FROM "
        f"({with_uniform(before, number_)}) JOIN w{tag} USING (term_id) JOIN d{tag} USING (doc_id), s{tag}, v{tag})",
        f"{after} AS MATERIALIZED ({choose('p' + tag, topics)})",
    ]


COPIES = """enc AS MATERIALIZED (
  SELECT doc_id, term_id,
         (row_number() OVER (PARTITION BY doc_id, term_id ORDER BY tok_pos) - 1)::BIGINT AS pos
  FROM (SELECT doc_id, term_id, pos AS tok_pos FROM tok JOIN vocab USING (term)))"""

EDGE_START = [WORDS, VOCAB, COPIES, FIRST]


def edge_step(number_: int, topics: int = K) -> list[str]:
    before, after = f"t{number_ - 1}", f"t{number_}"
    tag = f"_{number_ - 1}"
    weights = ", ".join(f"{edge_terms(k)} AS p{k}" for k in range(topics))
    return [
        *tables(before, tag, topics),
        f"p{tag} AS (SELECT doc_id, pos, term_id, topic AS was, u, {weights} FROM "
        f"({with_uniform(before, number_)}) JOIN c{tag} USING (doc_id, term_id) JOIN d{tag} USING (doc_id), s{tag}, v{tag})",
        f"{after} AS MATERIALIZED ({choose('p' + tag, topics)})",
    ]


# The state most results are computed from: one collapsed sweep after the start.
TRAINED = [*START_STATE, *sweep(1), *tables("t1", "")]
EDGE_TRAINED = [*EDGE_START, *edge_step(1), *tables("t1", "")]

TOPICS = f"topics AS (SELECT unnest(range({K}))::INT AS topic)"


def long(source: str, keys: str, prefix: str, value: str = "n", topics: int = K) -> str:
    """Wide counts to one row per topic."""
    return " UNION ALL ".join(
        f"SELECT {keys}{', ' if keys else ''}{k}::INT AS topic, {prefix}{k} AS {value} FROM {source}"
        for k in range(topics)
    )


def theta(k: int) -> str:
    return f"(d{k} + {ALPHA}::DOUBLE) / ({plus('d')} + {K}::DOUBLE * {ALPHA}::DOUBLE)"


def phi(k: int) -> str:
    return f"(w{k} + {BETA}::DOUBLE) / (s{k} + vocab_size * {BETA}::DOUBLE)"


PHI_LONG = "phi AS (" + " UNION ALL ".join(
    f"SELECT {k}::INT AS topic, term_id, w{k} AS n, {phi(k)} AS phi FROM w, s, v" for k in range(K)
) + ")"


def likelihood(smoothing: str, alpha: float, beta: float, grain: str, tag: str = "") -> str:
    """SELECT of the log likelihood and the number of tokens."""
    less = 1 if smoothing == "map" else 0
    n = "w" if grain == "term" else "n"
    norm = " + ".join(f"abs(d{k} + {alpha}::DOUBLE - {less})" for k in range(K))
    dot = " + ".join(
        f"({n}{k} + {beta}::DOUBLE - {less}) / (s{k} + vocab_size * {beta}::DOUBLE)"
        f" * (d{k} + {alpha}::DOUBLE - {less})"
        for k in range(K)
    )
    words = f"JOIN w{tag} USING (term_id)" if grain == "term" else ""
    return (
        f"SELECT sum(cnt * ln(({dot}) / ({norm}))) AS ll, sum(cnt) AS tokens"
        f" FROM c{tag} {words} JOIN d{tag} USING (doc_id), s{tag}, v{tag}"
    )


def digamma(x: str) -> str:
    """The series for x > 0 after six steps of the recurrence."""
    shift = "0.0::DOUBLE"
    for step in range(6):
        shift = f"{shift} + 1.0::DOUBLE / ({x} + {step}::DOUBLE)"
    y = f"({x} + 6::DOUBLE)"
    square = f"(1.0::DOUBLE / ({y} * {y}))"
    series = "0.0::DOUBLE"
    for top, bottom in reversed(((-1, 12), (1, 120), (-1, 252), (1, 240), (-1, 132))):
        series = f"({series} + {top}::DOUBLE / {bottom}::DOUBLE) * {square}"
    return f"(ln({y}) - 0.5::DOUBLE / {y} + {series} - ({shift}))"


def best_cell(weights: list[str], source: str) -> str:
    """Index of the largest weight, the first one on ties."""
    listed = ", ".join(weights)
    return (
        f"SELECT doc_id, term_id, (list_position(g, list_max(g)) - 1)::INT AS topic"
        f" FROM (SELECT doc_id, term_id, [{listed}] AS g FROM {source})"
    )


def statements() -> dict[str, str]:
    sql: dict[str, str] = {}

    blanks = " || ".join(f"chr({code})" for code in range(1, 0x21))
    sql["read_corpus"] = f"SELECT doc_id, trim(text, {blanks}) AS text FROM documents"
    sql["read_token_lines"] = r"""
      WITH lines AS (
        SELECT doc_id, text, string_split(rtrim(text, chr(10)), chr(10)) AS w FROM documents),
      kept AS (
        SELECT doc_id, CASE WHEN text = '' THEN [''] WHEN rtrim(text, chr(10)) = '' THEN []
                            ELSE w END AS w FROM lines)
      SELECT doc_id, unnest(range(len(w)))::INT AS pos, unnest(w) AS term FROM kept"""
    sql["assign_doc_ids"] = """
      SELECT row_number() OVER (ORDER BY url, page_id) - 1 AS doc_id, page_id, url FROM pages"""
    sql["tokenize"] = chain(WORDS) + " SELECT doc_id, pos, term FROM tok"
    sql["encode_tokens"] = chain(*CORPUS) + " SELECT doc_id, pos, term_id FROM enc"
    # The word a token was encoded from is the one it must be decoded to.
    sql["decode_terms"] = chain(WORDS, VOCAB) + (
        " SELECT doc_id, pos, term_id, term FROM tok JOIN vocab USING (term)"
    )
    sql["fit_vocabulary"] = chain(WORDS, VOCAB) + " SELECT term_id, term, n_tokens, n_docs FROM vocab"
    sql["fit_vocabulary_min_df"] = chain(WORDS) + """
      SELECT row_number() OVER (ORDER BY n_tokens DESC, term) - 1 AS term_id,
             term, n_tokens, n_docs
      FROM (SELECT term, count(*) AS n_tokens, count(DISTINCT doc_id) AS n_docs FROM tok
            GROUP BY term HAVING count(DISTINCT doc_id) >= 3
            ORDER BY n_tokens DESC, term LIMIT 1000)"""
    sql["distinct_vocabulary"] = r"""
      WITH kept AS (
        SELECT doc_id, CASE WHEN text = '' THEN [''] WHEN rtrim(text, chr(10)) = '' THEN []
                            ELSE string_split(rtrim(text, chr(10)), chr(10)) END AS w
        FROM documents),
      tok AS (SELECT doc_id, unnest(w) AS term FROM kept)
      SELECT row_number() OVER (ORDER BY term) - 1 AS term_id, term,
             count(*) AS n_tokens, count(DISTINCT doc_id) AS n_docs
      FROM tok GROUP BY term"""
    sql["count_vectorize"] = chain(*CORPUS) + (
        " SELECT doc_id, term_id, count(*) AS cnt FROM enc GROUP BY doc_id, term_id"
    )
    sql["bag_from_counts"] = """
      SELECT l_suppkey AS doc_id, l_partkey AS term_id,
             trunc(sum(l_quantity * 0.25::DOUBLE - 3))::BIGINT AS cnt
      FROM lineitem GROUP BY l_suppkey, l_partkey
      HAVING sum(l_quantity * 0.25::DOUBLE - 3) >= 1"""
    sql["corpus_summary"] = chain(WORDS, VOCAB) + """
      SELECT (SELECT count(*) FROM documents) AS documents,
             (SELECT count(*) FROM vocab) AS vocabulary,
             (SELECT sum(n_tokens)::BIGINT FROM vocab) AS tokens"""
    edges = """edges AS (
      SELECT doc_id AS src_id, -(1 + term_id::BIGINT + doc_id * (SELECT count(*) FROM vocab)) AS dst_id,
             count(*) AS cnt FROM enc GROUP BY doc_id, term_id)"""
    sql["doc_term_edges"] = chain(*CORPUS, edges) + " SELECT src_id, dst_id, cnt FROM edges"
    sql["decode_edges"] = chain(*CORPUS) + (
        " SELECT doc_id, term_id::BIGINT AS term_id, count(*) AS cnt FROM enc GROUP BY doc_id, term_id"
    )
    sql["graph_counts"] = chain(*CORPUS, edges) + """
      SELECT count(DISTINCT src_id) AS document_vertices, count(DISTINCT dst_id) AS term_vertices,
             count(*) AS edges FROM edges"""

    sql["init_assignments"] = chain(*START_STATE) + " SELECT doc_id, pos, term_id, topic FROM t0"
    sql["init_assignments_bag"] = chain(*EDGE_START) + " SELECT doc_id, pos, term_id, topic FROM t0"
    sql["word_topic_counts"] = chain(*START_STATE) + (
        " SELECT term_id, topic, count(*) AS n FROM t0 GROUP BY term_id, topic"
    )
    sql["word_topic_counts_doc_term"] = chain(*START_STATE) + (
        " SELECT doc_id, term_id, topic, count(*) AS n FROM t0 GROUP BY doc_id, term_id, topic"
    )
    sql["doc_topic_counts"] = chain(*START_STATE) + (
        " SELECT doc_id, topic, count(*) AS n FROM t0 GROUP BY doc_id, topic"
    )
    sql["doc_lengths"] = chain(*START_STATE) + (
        " SELECT doc_id, count(*) AS n FROM t0 GROUP BY doc_id"
    )
    sql["topic_totals"] = chain(*START_STATE, TOPICS) + (
        " SELECT topics.topic, count(t0.topic) AS n FROM topics LEFT JOIN t0 ON t0.topic = topics.topic"
        " GROUP BY topics.topic"
    )

    weighted = sweep(1)[:-1]
    sql["topic_weights"] = chain(*START_STATE, *weighted) + " SELECT doc_id, pos, topic, round(weight * 1e6, 6) AS weight FROM (" + long(
        "p_0", "doc_id, pos", "p", "weight"
    ) + ")"
    cell_weights = ", ".join(f"{edge_terms(k)} AS p{k}" for k in range(K))
    sql["topic_weights_edge"] = chain(
        *EDGE_START,
        *tables("t0", ""),
        f"p AS (SELECT doc_id, term_id, {cell_weights} FROM c JOIN d USING (doc_id), s, v)",
    ) + " SELECT doc_id, term_id, topic, round(weight * 1e6, 6) AS weight FROM (" + long(
        "p", "doc_id, term_id", "p", "weight"
    ) + ")"
    total = " + ".join(f"p{k}" for k in range(K))
    shares = ", ".join(f"p{k} / ({total}) AS g{k}" for k in range(K))
    sql["topic_shares_edge"] = chain(
        *EDGE_START,
        *tables("t0", ""),
        f"p AS (SELECT doc_id, term_id, {cell_weights} FROM c JOIN d USING (doc_id), s, v)",
        f"g AS (SELECT doc_id, term_id, {shares} FROM p)",
    ) + " SELECT doc_id, term_id, topic, round(weight, 6) AS weight FROM (" + long(
        "g", "doc_id, term_id", "g", "weight"
    ) + ")"
    sql["gibbs_sweep"] = chain(*START_STATE, *sweep(1)) + " SELECT doc_id, pos, term_id, topic FROM t1"
    sql["edge_sweep"] = chain(*EDGE_TRAINED) + (
        " SELECT doc_id, term_id, topic, n FROM (" + long("c", "doc_id, term_id", "n") + ") WHERE n > 0"
    )
    sql["fit_lda"] = chain(*START_STATE, *sweep(1), *sweep(2)) + (
        " SELECT doc_id, pos, term_id, topic FROM t2"
    )
    sql["fit_lda_edge"] = chain(*EDGE_START, *edge_step(1), *edge_step(2), *tables("t2", "")) + (
        " SELECT doc_id, term_id, topic, n FROM (" + long("c", "doc_id, term_id", "n") + ") WHERE n > 0"
    )
    for topics in MANY:
        start = [*CORPUS, first_topics(topics)]
        sql[f"gibbs_sweep_k{topics}"] = chain(*start, *sweep(1, topics)) + (
            " SELECT doc_id, pos, term_id, topic FROM t1"
        )
        start = [WORDS, VOCAB, COPIES, first_topics(topics)]
        sql[f"edge_sweep_k{topics}"] = chain(*start, *edge_step(1, topics)) + (
            " SELECT doc_id, term_id, topic, count(*) AS n FROM t1 GROUP BY ALL"
        )
    sql["tokens_changed"] = chain(*START_STATE, *sweep(1), *sweep(2)) + """
      SELECT 1::INT AS iteration, count(*) FILTER (topic <> was) AS tokens_changed FROM t1
      UNION ALL SELECT 2::INT, count(*) FILTER (topic <> was) FROM t2"""

    # One row per sweep: tokens whose topic changed, and the likelihood before it.
    def metrics(start: list[str], step, changed: str, alpha: float, beta: float) -> str:
        rows = " UNION ALL ".join(
            f"SELECT {i}::INT AS iteration, ({changed.format(i=i, before=i - 1)})::BIGINT AS tokens_changed,"
            f" round((SELECT ll FROM ({likelihood('mean', alpha, beta, 'term', f'_{i - 1}')})), 2) AS log_likelihood"
            for i in (1, 2)
        )
        return chain(*start, *step(1), *step(2), *tables("t2", "_2")) + " " + rows

    sql["iteration_metrics"] = metrics(
        START_STATE, sweep, "SELECT count(*) FILTER (topic <> was) FROM t{i}", ALPHA, BETA
    )
    gained = " + ".join(f"greatest(a.n{k} - b.n{k}, 0)" for k in range(K))
    sql["iteration_metrics_edge"] = metrics(
        EDGE_START,
        edge_step,
        f"SELECT sum({gained}) FROM c_{{i}} a JOIN c_{{before}} b USING (doc_id, term_id)",
        EDGE_ALPHA,
        EDGE_BETA,
    )

    sql["theta"] = chain(*TRAINED) + " UNION ALL ".join(
        f" SELECT doc_id, {k}::INT AS topic, round({theta(k)}, 6) AS theta FROM d" for k in range(K)
    )
    sql["theta_all_documents"] = chain(
        *TRAINED,
        "every AS (SELECT documents.doc_id, "
        + ", ".join(f"coalesce(d{k}, 0) AS d{k}" for k in range(K))
        + " FROM documents LEFT JOIN d USING (doc_id))",
    ) + " UNION ALL ".join(
        f" SELECT doc_id, {k}::INT AS topic, round({theta(k)}, 6) AS theta FROM every" for k in range(K)
    )
    sql["phi"] = chain(*TRAINED, PHI_LONG) + (
        " SELECT topic, term_id, round(phi * 1e3, 6) AS phi_permille FROM phi"
    )
    sql["phi_doc_term"] = chain(*TRAINED) + " UNION ALL ".join(
        f" SELECT {k}::INT AS topic, doc_id, term_id, round((n{k} + {BETA}::DOUBLE) /"
        f" (s{k} + vocab_size * {BETA}::DOUBLE) * 1e3, 6) AS phi_permille FROM c, s, v"
        for k in range(K)
    )
    sql["topics_matrix"] = chain(*TRAINED) + (
        " SELECT term_id, " + ", ".join(f"coalesce(w{k}, 0) AS t{k}" for k in range(K))
        + " FROM vocab LEFT JOIN w USING (term_id)"
    )
    sql["topic_distributions"] = chain(*TRAINED) + (
        " SELECT * FROM (" + long("d", "doc_id", "d", "weight") + ")"
    )
    sql["topic_distributions_normalized"] = chain(*TRAINED) + " UNION ALL ".join(
        f" SELECT doc_id, {k}::INT AS topic, round(d{k}::DOUBLE / ({plus('d')}), 6) AS weight FROM d"
        for k in range(K)
    )
    sql["topic_assignments"] = chain(*TRAINED) + " " + best_cell(
        [
            f"(w{k} + {BETA}::DOUBLE) / (s{k} + vocab_size * {BETA}::DOUBLE) * (d{k} + {ALPHA}::DOUBLE)"
            for k in range(K)
        ],
        "c JOIN w USING (term_id) JOIN d USING (doc_id), s, v",
    )
    sql["topic_assignments_edge"] = chain(*EDGE_TRAINED) + " " + best_cell(
        [edge_terms(k) for k in range(K)], "c JOIN d USING (doc_id), s, v"
    )
    sql["describe_topics"] = chain(*TRAINED, PHI_LONG) + """
      SELECT topic, rank, term_id, term, round(phi, 6) AS phi FROM (
        SELECT topic, term_id, phi,
               row_number() OVER (PARTITION BY topic ORDER BY n DESC, term_id)::INT AS rank FROM phi)
      JOIN vocab USING (term_id) WHERE rank <= 10"""
    sql["describe_topics_all"] = chain(*TRAINED, PHI_LONG) + """
      SELECT topic, term_id, term,
             row_number() OVER (PARTITION BY topic ORDER BY n DESC, term_id)::INT AS rank
      FROM phi JOIN vocab USING (term_id)"""
    sql["top_documents_per_topic"] = chain(*TRAINED) + """
      SELECT topic, rank, doc_id, weight FROM (
        SELECT topic, doc_id, weight,
               row_number() OVER (PARTITION BY topic ORDER BY weight DESC, doc_id DESC)::INT AS rank
        FROM (""" + long("d", "doc_id", "d", "weight") + """)) WHERE rank <= 20"""
    sql["top_documents_per_topic_5000"] = sql["top_documents_per_topic"].replace("rank <= 20", "rank <= 5000")
    sql["assignment_arrays"] = chain(*TRAINED) + (
        " SELECT doc_id, (r // 1024)::BIGINT AS part, list(term_id::BIGINT ORDER BY term_id) AS term_ids,"
        " list(topic ORDER BY term_id) AS topics FROM (SELECT *, row_number() OVER (PARTITION BY doc_id"
        " ORDER BY term_id) - 1 AS r FROM ("
    ) + best_cell(
        [
            f"(w{k} + {BETA}::DOUBLE) / (s{k} + vocab_size * {BETA}::DOUBLE) * (d{k} + {ALPHA}::DOUBLE)"
            for k in range(K)
        ],
        "c JOIN w USING (term_id) JOIN d USING (doc_id), s, v",
    ) + ")) GROUP BY doc_id, r // 1024"
    sql["top_topics_per_document"] = chain(*TRAINED) + """
      SELECT doc_id, rank, topic, round(n::DOUBLE / total, 6) AS weight FROM (
        SELECT doc_id, topic, n, sum(n) OVER (PARTITION BY doc_id) AS total,
               row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, topic)::INT AS rank
        FROM (""" + long("d", "doc_id", "d") + """)) WHERE rank <= 3"""

    sql["log_likelihood"] = chain(*TRAINED) + (
        f" SELECT round(ll, 2) AS log_likelihood FROM ({likelihood('mean', ALPHA, BETA, 'term')})"
    )
    sql["log_likelihood_map"] = chain(*EDGE_TRAINED) + (
        f" SELECT round(ll, 2) AS log_likelihood FROM ({likelihood('map', EDGE_ALPHA, EDGE_BETA, 'doc_term')})"
    )
    sql["perplexity"] = chain(*TRAINED) + (
        f" SELECT round(exp(-ll / tokens), 4) AS perplexity FROM ({likelihood('mean', ALPHA, BETA, 'term')})"
    )
    sql["perplexity_map"] = chain(*EDGE_TRAINED) + (
        f" SELECT round(exp(-ll / tokens), 4) AS perplexity"
        f" FROM ({likelihood('map', EDGE_ALPHA, EDGE_BETA, 'doc_term')})"
    )
    term_part = " + ".join(
        f"ln((w{k} + {EDGE_BETA - 1.0}::DOUBLE) / (s{k} + vocab_size * {EDGE_BETA - 1.0}::DOUBLE))"
        for k in range(K)
    )
    rest = EDGE_ALPHA - 1.0
    doc_norm = " + ".join(f"(d{k} + {rest!r}::DOUBLE)" for k in range(K))
    doc_part = " + ".join(f"ln((d{k} + {rest!r}::DOUBLE) / ({doc_norm}))" for k in range(K))
    sql["log_prior"] = chain(*EDGE_TRAINED) + f"""
      SELECT round((SELECT sum({EDGE_BETA - 1.0}::DOUBLE * ({term_part})) FROM w, s, v)
                 + (SELECT sum({rest!r}::DOUBLE * ({doc_part})) FROM d), 2) AS log_prior"""
    cell_part = term_part.replace("(w", "(n")
    sql["log_prior_doc_term"] = chain(*EDGE_TRAINED) + f"""
      SELECT round((SELECT sum({EDGE_BETA - 1.0}::DOUBLE * ({cell_part})) FROM c, s, v)
                 + (SELECT sum({rest!r}::DOUBLE * ({doc_part})) FROM d), 2) AS log_prior"""
    sql["log_sum_exp"] = """
      WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings)
      SELECT vec_id, round(max(m) + ln(sum(exp(x - m))), 6) AS log_sum_exp
      FROM (SELECT vec_id, x, max(x) OVER (PARTITION BY vec_id) AS m FROM x) GROUP BY vec_id"""
    sql["log_sum_exp_large"] = """
      SELECT l_suppkey, round(max(m) + ln(sum(exp(x - m))), 6) AS log_sum_exp
      FROM (SELECT l_suppkey, l_extendedprice AS x,
                   max(l_extendedprice) OVER (PARTITION BY l_suppkey) AS m FROM lineitem)
      GROUP BY l_suppkey"""
    sql["dirichlet_expectation"] = f"""
      SELECT row_id, k, alpha, round({digamma('alpha')} - {digamma('total')}, 6) AS e_log_theta
      FROM (SELECT l_orderkey AS row_id, l_linenumber AS k, l_quantity AS alpha,
                   sum(l_quantity) OVER (PARTITION BY l_orderkey) AS total FROM lineitem)"""

    sql["write_wordmap"] = chain(WORDS, VOCAB) + """
      SELECT count(*)::VARCHAR AS line FROM vocab
      UNION ALL SELECT term || ' ' || term_id FROM vocab"""
    sql["write_assignments"] = chain(*START_STATE, *sweep(1), """
      numbered AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS line_no
                   FROM (SELECT DISTINCT doc_id FROM t1))""") + """
      SELECT line_no, (pos // 1024)::BIGINT AS part,
             string_agg(term_id || ':' || topic, ' ' ORDER BY pos) AS line
      FROM t1 JOIN numbered USING (doc_id) GROUP BY line_no, pos // 1024"""
    sql["theta_lines"] = chain(*TRAINED) + " UNION ALL ".join(
        f" SELECT row_number() OVER (ORDER BY doc_id) - 1 AS line_no, {k}::INT AS topic,"
        f" round({theta(k)}, 6) AS value FROM d"
        for k in range(K)
    )
    sql["phi_lines"] = chain(*TRAINED, PHI_LONG) + (
        " SELECT topic AS line_no, term_id, round(phi * 1e3, 6) AS value_permille FROM phi"
    )
    sql["tassign_file"] = chain(*START_STATE, *sweep(1)) + """
      SELECT string_agg(term_id || ':' || topic, ' ' ORDER BY pos) || ' ' AS line FROM t1 GROUP BY doc_id"""
    sql["theta_file"] = chain(*TRAINED) + " UNION ALL ".join(
        f" SELECT {k}::INT AS topic, round({theta(k)}, 6) AS theta FROM d" for k in range(K)
    )
    sql["phi_file"] = chain(*TRAINED, PHI_LONG) + (
        " SELECT term_id::INT AS term_id, round(phi * 1e3, 6) AS phi_permille FROM phi"
    )
    sql["others_lines"] = chain(*CORPUS) + f"""
      SELECT unnest(['alpha={ALPHA}', 'beta={BETA}', 'ntopics={K}',
                     'ndocs=' || (SELECT count(DISTINCT doc_id) FROM enc),
                     'nwords=' || (SELECT count(*) FROM vocab), 'liter=0']) AS line"""
    sql["twords_lines"] = chain(*TRAINED, PHI_LONG) + """
      SELECT topic, rank, 'Topic ' || topic || 'th:' AS word, NULL::DOUBLE AS phi
      FROM (SELECT DISTINCT topic, 0::INT AS rank FROM phi)
      UNION ALL
      SELECT topic, rank, term, round(phi, 6) FROM (
        SELECT topic, term_id, phi,
               row_number() OVER (PARTITION BY topic ORDER BY n DESC, term_id)::INT AS rank FROM phi)
      JOIN vocab USING (term_id) WHERE rank <= 10"""
    sql["twords_file"] = f"SELECT word, phi FROM ({sql['twords_lines']})"
    return sql
