"""The named queries in SQL, for DuckDB on the same tables.

Written from the definitions, not from the Spark plans: global positions are
plain ``row_number()`` here, walks are recursive queries, splits are look-ups.
"""

from __future__ import annotations

import string

# Text pieces shared by the statements.

WHITESPACE = r"[\t-\r\x1c-\x1f\x{85}\p{Z}]"


def _lines(table: str, *columns: str) -> str:
    """Lines of a table's text, numbered from 0."""
    kept = "".join(f"{c}, " for c in columns)
    return f"""
        SELECT {kept}unnest(parts) AS text,
               CAST(generate_subscripts(parts, 1) - 1 AS BIGINT) AS line_no
        FROM (SELECT {kept}CASE WHEN parts[len(parts)] = '' THEN parts[1:len(parts) - 1]
                            ELSE parts END AS parts
              FROM (SELECT {kept}string_split(text, chr(10)) AS parts FROM {table}))"""


LINES = f"lines AS ({_lines('documents', 'doc_id', 'source')})"


def _words(text: str = "text") -> str:
    marked = f"replace({text}, '&amp;', ' &amp;')"
    marked = f"regexp_replace({marked}, '([()!.?,$~+*])', ' \\1 ', 'g')"
    marked = f"regexp_replace({marked}, '\\p{{Nd}}', ' ', 'g')"
    marked = f"translate({marked}, '\"''', '')"
    return f"list_filter(string_split({marked}, ' '), lambda t: t <> '')"


def _chars(text: str = "text") -> str:
    return f"CASE WHEN {text} = '' THEN CAST([] AS VARCHAR[]) ELSE string_split({text}, '') END"


def _spaces(text: str = "text") -> str:
    return f"list_filter(regexp_split_to_array({text}, '{WHITESPACE}+'), lambda t: t <> '')"


def _strict(text: str) -> str:
    text = f"regexp_replace({text}, 'https?://[^ ]+', '', 'g')"
    text = f"regexp_replace({text}, '@[^ ]+', '', 'g')"
    text = f"replace({text}, '#', '')"
    for letter in string.ascii_letters:
        text = f"regexp_replace({text}, '{letter}{{3,}}', '{letter}', 'g')"
    text = f"replace({text}, ' 0 ', 'zero')"
    text = f"regexp_replace({text}, '[^A-Za-z ]', '', 'g')"
    return f"ltrim(lower({text}), ' ')"


def _general(text: str) -> str:
    text = rf"regexp_replace({text}, '(?:https?://|www\.)[^ \t\r\n\f]+', '<url>', 'g')"
    text = rf"regexp_replace({text}, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}', '<email>', 'g')"
    text = rf"regexp_replace({text}, '\p{{Sc}}', '<cur>', 'g')"
    text = rf"regexp_replace(strip_accents({text}), '[^\x00-\x7F]', '', 'g')"
    text = rf"regexp_replace({text}, '\b[0-9]+(?:[.,][0-9]+)*\b', '<number>', 'g')"
    text = rf"regexp_replace({text}, '[0-9]', '0', 'g')"
    text = rf"regexp_replace(lower({text}), '[ \t\f\x0B]+', ' ', 'g')"
    return f"trim({text}, ' ')"


def _letters(text: str) -> str:
    return f"lower(trim(regexp_replace({text}, '[^A-Za-z]+', ' ', 'g'), ' '))"


WORDS = f"words AS (SELECT doc_id, line_no, source, text, {_words()} AS toks FROM lines)"
TOKENS = """tokens AS (
    SELECT doc_id, line_no, source, unnest(toks) AS token,
           CAST(generate_subscripts(toks, 1) - 1 AS BIGINT) AS pos
    FROM words)"""


def _split(lines: str = "lines") -> str:
    """Lines with their part by position; the two gap lines are left out."""
    return f"""split AS (
        SELECT * FROM (
            SELECT * EXCLUDE (r, n),
                   CASE WHEN r < n // 2 THEN 'train'
                        WHEN r > n // 2 AND r < n * 3 // 4 THEN 'val'
                        WHEN r > n * 3 // 4 THEN 'test' END AS split
            FROM (SELECT *, row_number() OVER (ORDER BY doc_id, line_no) - 1 AS r,
                         count(*) OVER () AS n
                  FROM {lines}))
        WHERE split IS NOT NULL)"""


def _vocab(source: str, min_freq: int, name: str = "vocab") -> str:
    """A vocabulary from a query of tokens: markers first, then by frequency."""
    return f"""{name} AS (
        SELECT token, CAST(2 + row_number() OVER (ORDER BY freq DESC, token) AS BIGINT) AS idx,
               freq
        FROM (SELECT token, count(*) AS freq FROM ({source}) GROUP BY token)
        WHERE freq >= {min_freq} AND token NOT IN ('<unk>', '<BOS>', '<EOS>')
        UNION ALL
        SELECT * FROM (VALUES ('<unk>', CAST(0 AS BIGINT), CAST(0 AS BIGINT)),
                              ('<BOS>', 1, 0), ('<EOS>', 2, 0)))"""


WRAPPED = f"""wrapped AS (
    SELECT * EXCLUDE (text), list_concat(['<BOS>'], {_words()}, ['<EOS>']) AS toks FROM split)"""


def _pairs(source: str = "wrapped", keys: str = "split, doc_id, line_no") -> str:
    return f"""pairs AS (
        SELECT * FROM (
            SELECT {keys}, pos, token AS prev,
                   lead(token) OVER (PARTITION BY {keys} ORDER BY pos) AS next
            FROM (SELECT {keys}, unnest(toks) AS token,
                         CAST(generate_subscripts(toks, 1) - 1 AS BIGINT) AS pos
                  FROM {source}))
        WHERE next IS NOT NULL)"""


BIGRAMS = """bigrams AS (
    SELECT prev, next, count(*) AS n FROM pairs WHERE split = 'train' GROUP BY prev, next)"""
SCORES = """
    seen AS (SELECT prev, next, count(*) FILTER (split = 'train') AS c
             FROM pairs WHERE split IN ('train', 'val') GROUP BY prev, next),
    totals AS (SELECT prev, sum(c) AS t FROM seen GROUP BY prev),
    scores AS (SELECT seen.prev, seen.next,
                      -ln((c + 1.0::DOUBLE) / (t + (SELECT count(DISTINCT next) FROM seen))) AS nll
               FROM seen JOIN totals ON seen.prev = totals.prev)"""
LENGTH_RANK = """batched AS (
    SELECT *, len(toks) AS n,
           (row_number() OVER (PARTITION BY split ORDER BY len(toks), doc_id, line_no) - 1)
               // (CASE split WHEN 'train' THEN 64 ELSE 16 END) AS batch,
           (row_number() OVER (PARTITION BY split ORDER BY len(toks), doc_id, line_no) - 1)
               % (CASE split WHEN 'train' THEN 64 ELSE 16 END) AS row
    FROM {source})"""
PROMPTS = r"""prompts AS (
    SELECT DISTINCT prompt
    FROM (SELECT translate(string_split(text, ' ')[1], '\.!"', '') AS prompt FROM lines)
    WHERE length(prompt) > 1)"""
CHECKED = f"""checked AS (
    SELECT prompt, toks, len(toks) AS n_tokens, coalesce(n_unknown, 0) AS n_unknown,
           CASE WHEN len(toks) = 0 THEN 'no_tokens'
                WHEN first_unknown = 1 THEN 'first_unknown'
                WHEN n_unknown > 0 THEN 'later_unknown' ELSE 'ok' END AS status
    FROM (SELECT prompt, {_words('prompt')} AS toks FROM prompts)
    LEFT JOIN (
        SELECT prompt, count(*) AS n_unknown, min(pos) AS first_unknown
        FROM (SELECT prompt, unnest({_words('prompt')}) AS token,
                     generate_subscripts({_words('prompt')}, 1) AS pos FROM prompts)
        WHERE token NOT IN (SELECT token FROM vocab) GROUP BY prompt)
    USING (prompt))"""
TRAIN_MODEL = ",\n".join(
    [LINES, _split(), WRAPPED, _pairs(), BIGRAMS,
     _vocab("SELECT next AS token FROM pairs WHERE split = 'train' AND next <> '<EOS>'", 0),
     PROMPTS, CHECKED]
)
STREAM = f"""chars AS (
        SELECT doc_id, line_no, unnest(toks) AS token, generate_subscripts(toks, 1) AS pos
        FROM (SELECT doc_id, line_no, {_chars(_letters('text'))} AS toks FROM lines)),
    symbols AS (
        SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) AS idx
        FROM chars GROUP BY token),
    stream AS (
        SELECT doc_id, idx, row_number() OVER (ORDER BY doc_id, line_no, pos) - 1 AS p
        FROM chars JOIN symbols USING (token)),
    n AS (SELECT count(*) AS n FROM stream)"""
BATCH_TEXT = """
    SELECT batch, row, string_agg(idx, ' ' ORDER BY p) AS x_text,
           string_agg(y, ' ' ORDER BY p) AS y_text
    FROM ({rows}) GROUP BY batch, row"""

RANDOM = (
    "subs AS (SELECT unnest(range((n - 5 - 1) // 35)) AS k, (n - 5 - 1) // 35 AS m FROM n)",
    "ranks AS (SELECT k, m, row_number() OVER (ORDER BY md5('7:' || k), k) - 1 AS r FROM subs)",
)
RANDOM_TEXT = BATCH_TEXT.format(rows="""
            SELECT r // 32 AS batch, r % 32 AS row, s.p, s.idx, y.idx AS y
            FROM stream s JOIN ranks ON (s.p - 5) // 35 = k AND s.p >= 5
            JOIN stream y ON y.p = s.p + 1
            WHERE r < m // 32 * 32""")
ROWS_OF_32 = "size AS (SELECT (n - 5 - 1) // 32 AS l FROM n)"
SEQUENTIAL_TEXT = BATCH_TEXT.format(rows="""
            SELECT ((s.p - 5) % l) // 35 AS batch, (s.p - 5) // l AS row, s.p, s.idx, y.idx AS y
            FROM stream s JOIN stream y ON y.p = s.p + 1, size
            WHERE s.p >= 5 AND s.p < 5 + 32 * l AND ((s.p - 5) % l) // 35 < l // 35""")


def _part(start: str, end: str) -> str:
    """The stream from one position up to another, counted anew from 0."""
    whole = STREAM.replace("stream AS", "whole AS").replace("n AS (SELECT count(*) AS n FROM stream)",
                                                            "size_of AS (SELECT count(*) AS n FROM whole)")
    return f"""{whole},
    stream AS (SELECT doc_id, idx, p - {start} AS p FROM whole, size_of WHERE p >= {start} AND p < {end}),
    n AS (SELECT count(*) AS n FROM stream)"""


def _with(*parts: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + f"\n{select}"


def _tokenized(found: str, separator: str) -> str:
    return _with(
        LINES,
        select=f"""SELECT doc_id, line_no, len(t) AS n_tokens,
                   coalesce(array_to_string(t, '{separator}'), '') AS tokens_text
                   FROM (SELECT doc_id, line_no, {found} AS t FROM lines)""",
    )


def _greedy(policy: str, steps: int, starts: str) -> str:
    """Successors of a start token, taken one at a time."""
    where = "WHERE next <> '<EOS>'" if policy == "suppress_eos" else ""
    return f"""
        best AS (
            SELECT prev, next FROM (
                SELECT prev, next,
                       row_number() OVER (PARTITION BY prev ORDER BY n DESC, next) AS r
                FROM bigrams {where}) WHERE r = 1),
        walk AS (
            SELECT start, start AS token, 0 AS step, CAST([] AS VARCHAR[]) AS path
            FROM ({starts})
            UNION ALL
            SELECT start, next, step + 1, list_append(path, next)
            FROM walk JOIN best ON walk.token = best.prev WHERE step < {steps}),
        walked AS (
            SELECT start, max_by(path, step) AS path FROM walk GROUP BY start)"""


ORACLE: dict[str, str] = {
    "corpus_lines": _with(LINES, select="SELECT doc_id, source, line_no, text FROM lines"),
    "union_corpora": _with(
        LINES,
        f"talks AS ({_lines('conversations', 'conv_id', 'turn', 'role')})",
        select="""
            SELECT 'documents' AS corpus, doc_id AS id, source, line_no, text,
                   CAST(NULL AS BIGINT) AS turn, CAST(NULL AS VARCHAR) AS role FROM lines
            UNION ALL
            SELECT 'conversations', conv_id, NULL, line_no, text, turn, role FROM talks""",
    ),
    "clean_general": _with(
        LINES, select=f"SELECT doc_id, line_no, {_general('text')} AS text_clean FROM lines"
    ),
    "clean_strict": _with(
        LINES, select=f"SELECT doc_id, line_no, {_strict('text')} AS text_clean FROM lines"
    ),
    "clean_letters": _with(
        LINES, select=f"SELECT doc_id, line_no, {_letters('text')} AS text_clean FROM lines"
    ),
    "drop_blank": _with(
        LINES,
        select=f"""
            SELECT doc_id,
                   CASE WHEN NOT regexp_full_match(source, '{WHITESPACE}*') THEN source END AS source,
                   line_no,
                   CASE WHEN NOT regexp_full_match(text, '{WHITESPACE}*') THEN text END AS text,
                   text_clean
            FROM (SELECT *, {_strict('text')} AS text_clean FROM lines)
            WHERE NOT regexp_full_match(text_clean, '{WHITESPACE}*')""",
    ),
    "positional_split": _with(
        LINES, _split(), select="SELECT doc_id, line_no, split, text FROM split"
    ),
    "prepared_corpus": _with(
        LINES,
        f"clean AS (SELECT doc_id, line_no, {_general('text')} AS general FROM lines)",
        f"strict AS (SELECT doc_id, line_no, {_strict('general')} AS text_clean FROM clean)",
        f"""kept AS (
            SELECT doc_id, text_clean,
                   row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS line_no
            FROM strict WHERE NOT regexp_full_match(text_clean, '{WHITESPACE}*'))""",
        _split("kept"),
        select="SELECT doc_id, line_no, split, text_clean FROM split",
    ),
    "tokenize_char": _tokenized(_chars(), "|"),
    "tokenize_space": _tokenized(_spaces(), " "),
    "tokenize_word": _tokenized(_words(), " "),
    "words_per_sequence": _with(
        LINES,
        select=f"""
            SELECT doc_id, line_no,
                   length(text) - length(replace(text, ' ', '')) + 1 AS char_words,
                   len({_words()}) AS word_words,
                   length(text) - length(replace(text, ' ', ''))
                   + length(text) - length(replace(text, 'Ġ', '')) - 1 AS byte_level_words,
                   len({_spaces()})
                   - (length(joined) - length(replace(joined, '##', ''))) // 2 AS subword_words
            FROM (SELECT *, array_to_string({_spaces()}, '') AS joined FROM lines)""",
    ),
    "token_counts": _with(
        LINES,
        select=f"""
            SELECT kind, token, count(*) AS freq
            FROM (SELECT 'char' AS kind, unnest({_chars()}) AS token FROM lines
                  UNION ALL
                  SELECT 'word', unnest({_words()}) FROM lines)
            GROUP BY kind, token""",
    ),
    "word_counts": _with(
        LINES, WORDS, TOKENS,
        select="SELECT source, token, count(*) AS freq FROM tokens GROUP BY source, token",
    ),
    "top_words": _with(
        LINES, WORDS, TOKENS,
        select="""SELECT token, count(*) AS freq FROM tokens GROUP BY token
                  ORDER BY freq DESC, token LIMIT 100""",
    ),
    "topk_words": _with(
        LINES, WORDS, TOKENS,
        select="""
            SELECT * FROM (
                SELECT source, token, count(*) AS freq,
                       row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, token) AS rank
                FROM tokens GROUP BY source, token)
            WHERE rank <= 100""",
    ),
    "topk_overlap": _with(
        LINES, WORDS, TOKENS,
        """truth AS (SELECT token FROM tokens GROUP BY token
                     ORDER BY count(*) DESC, token LIMIT 100)""",
        f"""gen AS (
            SELECT 'benchmark' AS run, text FROM ({_lines('benchmark')})
            UNION ALL SELECT role, text FROM ({_lines('conversations', 'role')}))""",
        f"""tops AS (
            SELECT run, token FROM (
                SELECT run, token,
                       row_number() OVER (PARTITION BY run ORDER BY count(*) DESC, token) AS r
                FROM (SELECT run, unnest({_words()}) AS token FROM gen) GROUP BY run, token)
            WHERE r <= 100)""",
        select="""SELECT run, count(*) AS n_top, count(*) FILTER (token IN (FROM truth)) AS overlap
                  FROM tops GROUP BY run""",
    ),
    "length_histogram": _with(
        LINES,
        select=f"""SELECT len({_spaces()}) AS n_words, count(*) AS n_lines
                   FROM lines WHERE text <> '' GROUP BY 1 ORDER BY 1""",
    ),
    "length_summary": _with(
        LINES,
        select=f"""
            SELECT count(*) AS n_bins, CAST(sum(c) AS BIGINT) AS n_lines,
                   round(avg(c), 6) AS mean_bin_count,
                   round(sum(w * c)::DOUBLE / sum(c), 6) AS mean_words
            FROM (SELECT len({_spaces()}) AS w, count(*) AS c FROM lines
                  WHERE text <> '' GROUP BY 1)""",
    ),
    "corpus_stats": _with(
        LINES, WORDS, TOKENS,
        select="""
            SELECT (SELECT count(*) FROM documents) AS n_docs,
                   (SELECT count(*) FROM lines) AS n_lines,
                   (SELECT count(*) FROM tokens) AS n_tokens,
                   (SELECT count(DISTINCT token) FROM tokens) AS n_types,
                   (SELECT max(c) FROM (SELECT count(*) AS c FROM tokens GROUP BY token)) AS max_freq""",
    ),
    "prompts": _with(LINES, PROMPTS, select="SELECT prompt FROM prompts ORDER BY prompt"),
    "prompts_in_vocab": _with(
        LINES, WORDS, TOKENS, _vocab("SELECT token FROM tokens", 0), PROMPTS, CHECKED,
        select="SELECT prompt, n_tokens, n_unknown, status FROM checked",
    ),
    "run_grid": _with(
        LINES,
        select=f"""
            SELECT source, tokenizer,
                   CAST(sum(CASE tokenizer WHEN 'char' THEN len({_chars()})
                                           WHEN 'space' THEN len({_spaces()})
                                           ELSE len({_words()}) END) AS BIGINT) AS n_tokens
            FROM lines, (VALUES ('char'), ('space'), ('word')) AS t(tokenizer)
            GROUP BY source, tokenizer""",
    ),
    "build_vocab": _with(
        LINES, _split(),
        _vocab(f"SELECT unnest({_words()}) AS token FROM split WHERE split IN ('train', 'val')", 2),
        select="SELECT token, idx, freq FROM vocab",
    ),
    "encode": _with(
        LINES, WORDS, TOKENS, _vocab("SELECT token FROM tokens", 0),
        select="""SELECT doc_id, line_no, pos, coalesce(idx, 0) AS idx
                  FROM tokens LEFT JOIN vocab USING (token)""",
    ),
    "decode": _with(
        LINES, WORDS, TOKENS, _vocab("SELECT token FROM tokens", 0),
        select="""SELECT doc_id, line_no,
                         string_agg(coalesce(vocab.token, '<unk>'), ' ' ORDER BY pos) AS text
                  FROM tokens LEFT JOIN vocab ON tokens.token = vocab.token
                  GROUP BY doc_id, line_no""",
    ),
    "global_position": _with(
        LINES, WORDS, TOKENS,
        select="""SELECT doc_id, token,
                         row_number() OVER (ORDER BY doc_id, line_no, pos) - 1 AS global_pos
                  FROM tokens""",
    ),
    "wrap_sequences": _with(
        LINES, WORDS,
        select="""SELECT doc_id, line_no, len(toks) + 2 AS n,
                         array_to_string(list_concat(['<BOS>'], toks, ['<EOS>']), ' ') AS tokens_text
                  FROM words""",
    ),
    "block_truncate": _with(
        LINES, WORDS,
        select=f"""SELECT doc_id, line_no, len(toks[1:32]) AS n,
                          coalesce(array_to_string(toks[1:32], ' '), '') AS tokens_text
                   FROM words WHERE NOT regexp_full_match(text, '{WHITESPACE}*')""",
    ),
    "next_token_pairs": _with(
        LINES,
        f"wrapped AS (SELECT doc_id, line_no, list_concat(['<BOS>'], {_words()}, ['<EOS>']) AS toks FROM lines)",
        _pairs(keys="doc_id, line_no"),
        select="SELECT doc_id, line_no, pos, prev, next FROM pairs",
    ),
    "slice_corpus": _with(
        LINES, STREAM,
        select="""
            SELECT doc_id, min(p) AS from_pos, max(p) + 1 AS to_pos,
                   string_agg(idx, ' ' ORDER BY p) AS ids_text
            FROM stream, n
            WHERE p >= CAST(floor(0.1::DOUBLE * n) AS BIGINT)
              AND p < CAST(floor(0.9::DOUBLE * n) AS BIGINT)
            GROUP BY doc_id""",
    ),
    "random_subsequences": _with(LINES, STREAM, *RANDOM, select=RANDOM_TEXT),
    "sequential_batches": _with(LINES, STREAM, ROWS_OF_32, select=SEQUENTIAL_TEXT),
    "random_subsequences_part": _with(
        LINES, _part("CAST(floor(0.1::DOUBLE * n) AS BIGINT)", "CAST(floor(0.9::DOUBLE * n) AS BIGINT)"),
        *RANDOM, select=RANDOM_TEXT,
    ),
    "sequential_batches_part": _with(LINES, _part("1000", "n - 500"), ROWS_OF_32, select=SEQUENTIAL_TEXT),
    "length_batches": _with(
        LINES, _split(), WRAPPED, LENGTH_RANK.format(source="wrapped"),
        select="SELECT split, doc_id, line_no, n, batch, row FROM batched",
    ),
    "pad_batches": _with(
        LINES, _split(), WRAPPED, LENGTH_RANK.format(source="wrapped"),
        select="""
            SELECT split, batch, row, n, width,
                   array_to_string(list_resize(toks, width, '<pad>'), ' ') AS tokens_text
            FROM (SELECT *, max(n) OVER (PARTITION BY split, batch) AS width FROM batched)""",
    ),
    "causal_labels": _with(
        LINES, WORDS, TOKENS, _vocab("SELECT token FROM tokens", 0), _split(),
        f"""cut AS (SELECT * FROM (SELECT split, doc_id, line_no, ({_words()})[1:32] AS toks FROM split)
                    WHERE len(toks) > 0)""",
        LENGTH_RANK.format(source="cut"),
        """coded AS (
            SELECT split, batch, row, n, list(coalesce(idx, 0) ORDER BY pos) AS ids
            FROM (SELECT *, unnest(toks) AS token, generate_subscripts(toks, 1) AS pos FROM batched)
            LEFT JOIN vocab USING (token) GROUP BY split, batch, row, n)""",
        select="""
            SELECT split, batch, row, n,
                   array_to_string(list_resize(ids, width, -1), ' ') AS ids_text,
                   array_to_string(list_resize(ids, width, -100), ' ') AS labels_text
            FROM (SELECT *, max(n) OVER (PARTITION BY split, batch) AS width FROM coded)""",
    ),
    "bigram_counts": _with(
        LINES, _split(), WRAPPED, _pairs(), BIGRAMS, select="SELECT prev, next, n FROM bigrams"
    ),
    "next_token_top2": _with(
        LINES, _split(), WRAPPED, _pairs(), BIGRAMS,
        select="""
            SELECT * FROM (
                SELECT prev, next, n,
                       row_number() OVER (PARTITION BY prev ORDER BY n DESC, next) AS rank
                FROM bigrams)
            WHERE rank <= 2""",
    ),
    "score_tokens": _with(
        LINES, _split(), WRAPPED, _pairs(), SCORES,
        select="""SELECT doc_id, line_no, pos, prev, next, round(nll, 6) AS nll
                  FROM pairs JOIN scores USING (prev, next) WHERE split = 'val'""",
    ),
    "perplexity": _with(
        LINES, _split(), WRAPPED, LENGTH_RANK.format(source="wrapped"),
        _pairs("batched", "split, batch, row"), SCORES,
        """losses AS (SELECT split, batch, sum(nll) AS nll, count(*) AS t,
                             count(*) FILTER (next <> '<EOS>') AS w
                      FROM pairs JOIN scores USING (prev, next)
                      WHERE split IN ('train', 'val') GROUP BY split, batch)""",
        select="""
            SELECT split, count(*) AS n_batches, CAST(sum(t) AS BIGINT) AS n_tokens,
                   CAST(sum(w) AS BIGINT) AS n_words, round(sum(nll) / sum(t), 6) AS loss,
                   round(exp(sum(nll) / sum(t)), 6) AS ppl_token,
                   round(exp(sum(nll / t * w) / sum(w)), 6) AS ppl_word_weighted,
                   round(exp(sum(nll) / sum(w)), 6) AS ppl_word_normalised
            FROM losses GROUP BY split""",
    ),
    "experiment_summary": _with(
        LINES, _split(),
        f"""toks AS (
            SELECT split, doc_id, line_no, tokenizer,
                   list_concat(['<BOS>'], CASE tokenizer WHEN 'char' THEN {_chars()}
                                                         WHEN 'space' THEN {_spaces()}
                                                         ELSE {_words()} END, ['<EOS>']) AS toks
            FROM split, (VALUES ('char'), ('space'), ('word')) AS t(tokenizer)
            WHERE split IN ('train', 'val'))""",
        _pairs("toks", "tokenizer, split, doc_id, line_no"),
        """sizes AS (SELECT tokenizer, count(DISTINCT next) AS v,
                            count(*) FILTER (split = 'train') AS tr,
                            count(*) FILTER (split = 'val') AS va FROM pairs GROUP BY tokenizer)""",
        """two AS (SELECT tokenizer, prev, next, count(*) FILTER (split = 'train') AS n,
                          count(*) FILTER (split = 'val') AS m
                   FROM pairs GROUP BY tokenizer, prev, next)""",
        "one AS (SELECT tokenizer, next, sum(n) AS n, sum(m) AS m FROM two GROUP BY tokenizer, next)",
        "prevs AS (SELECT tokenizer, prev, sum(n) AS t FROM two GROUP BY tokenizer, prev)",
        """scored AS (
            SELECT 'bigram' AS model, tokenizer, n, m, -ln((n + 1.0::DOUBLE) / (t + v)) AS nll
            FROM two JOIN prevs USING (tokenizer, prev) JOIN sizes USING (tokenizer)
            UNION ALL
            SELECT 'unigram', tokenizer, n, m, -ln((n + 1.0::DOUBLE) / (tr + v))
            FROM one JOIN sizes USING (tokenizer))""",
        select="""
            SELECT model || '-' || tokenizer AS run, model, tokenizer, v AS vocab_size,
                   tr AS train_tokens, va AS val_tokens,
                   round(exp(sum(n * nll) / tr), 6) AS train_ppl,
                   round(exp(sum(m * nll) / va), 6) AS val_ppl
            FROM scored JOIN sizes USING (tokenizer) GROUP BY model, tokenizer, v, tr, va""",
    ),
    "generate_greedy": _with(
        TRAIN_MODEL,
        _greedy("suppress_eos", 50, "SELECT DISTINCT toks[len(toks)] AS start FROM checked WHERE status = 'ok'"),
        select="""
            SELECT prompt, len(path) AS n_generated,
                   array_to_string(list_concat(toks, path), ' ') AS output
            FROM checked JOIN walked ON start = toks[len(toks)] WHERE status = 'ok'""",
        recursive=True,
    ),
    "generate_sampled": _with(
        TRAIN_MODEL,
        "totals AS (SELECT prev, sum(n) AS total FROM bigrams GROUP BY prev)",
        """spans AS (
            SELECT prev, next, n,
                   sum(n) OVER (PARTITION BY prev ORDER BY coalesce(idx, -1)) AS high
            FROM bigrams LEFT JOIN vocab ON next = token)""",
        """walk AS (
            SELECT prompt, CAST(s AS BIGINT) AS sample_no, toks, len(toks) AS size
            FROM checked, range(2) AS r(s) WHERE status = 'ok'
            UNION ALL
            SELECT prompt, sample_no, list_append(toks, next), size + 1
            FROM (
                SELECT walk.*, totals.prev,
                       CAST('0x' || substr(md5(concat_ws('|', '7', prompt, sample_no, size)), 1, 15)
                            AS BIGINT) % total AS drawn
                FROM walk JOIN totals ON totals.prev = toks[len(toks)]
                WHERE size < 30) w
            JOIN spans ON spans.prev = w.prev AND drawn >= high - n AND drawn < high
            WHERE next <> '<EOS>')""",
        select="""SELECT prompt, sample_no, array_to_string(max_by(toks, size), ' ') AS output
                  FROM walk GROUP BY prompt, sample_no""",
        recursive=True,
    ),
    "probe_prompts": _with(
        TRAIN_MODEL,
        """probes AS (
            SELECT CAST(0 AS BIGINT) AS probe, '<BOS>' AS prompt, '<BOS>' AS start
            UNION ALL SELECT idx - 20, '<BOS> ' || token, token FROM vocab WHERE idx IN (21, 22)
            UNION ALL SELECT * FROM (
                SELECT 2 + row_number() OVER (ORDER BY md5('7:' || token), token) AS probe,
                       '<BOS> ' || token, token
                FROM vocab) WHERE probe <= 6)""",
        _greedy("stop_at_eos", 100, "SELECT DISTINCT start FROM probes"),
        select="""SELECT probe, prompt, concat_ws(' ', prompt, nullif(array_to_string(path, ' '), '')) AS output
                  FROM probes JOIN walked USING (start)""",
        recursive=True,
    ),
}

# levenshtein() counts bytes here, so each accented letter of the tables is given a
# control character of its own; any other character beyond ASCII gets the last one.
ACCENTED = "éèêíçñóüöäßÉÈÊÍÇÑÓÜÖÄ"
CONTROLS = " || ".join(f"chr({code})" for code in [*range(1, 10), *range(11, 23)])


def _one_byte(text: str) -> str:
    return (
        f"regexp_replace(translate({text}, '{ACCENTED}', {CONTROLS}), '[^\\x00-\\x7F]', chr(23), 'g')"
    )


NEAREST = f"""
    originals AS (
        SELECT text, min(struct_pack(doc_id := doc_id, line_no := line_no)) AS key,
               {_one_byte('text')} AS b
        FROM lines GROUP BY text),
    generated AS ({_lines('benchmark', 'item_id')}),
    nearest AS (
        SELECT g.text AS generated,
               min(struct_pack(distance := levenshtein(g.b, o.b), key := o.key,
                               original := o.text)) AS best
        FROM (SELECT DISTINCT text, {_one_byte('text')} AS b FROM generated) g, originals o
        GROUP BY g.text)"""

ORACLE["nearest_original"] = _with(
    LINES, NEAREST,
    select="""SELECT generated, best.distance AS distance, best.key.doc_id AS doc_id,
                     best.key.line_no AS line_no, best.original AS original FROM nearest""",
)
ORACLE["similarity_by_run"] = _with(
    LINES, NEAREST,
    select="""SELECT item_id, count(*) AS n_texts, round(avg(best.distance), 6) AS mean_distance
              FROM generated JOIN nearest ON text = nearest.generated GROUP BY item_id""",
)
MATCHED = (
    LINES,
    f"words AS (SELECT doc_id, line_no, {_words('lower(text)')} AS toks FROM lines)",
    """tokens AS (SELECT doc_id, line_no, unnest(toks) AS word, generate_subscripts(toks, 1) AS pos
                  FROM words)""",
    "types AS (SELECT word, count(*) AS freq FROM tokens GROUP BY word)",
    f"talks AS ({_lines('conversations')})",
    f"""entries AS (
        SELECT unnest({_words('lower(text)')}) AS entry FROM talks
        UNION SELECT unnest(string_split(word, '')) FROM types)""",
    """vocab AS (SELECT entry FROM entries UNION SELECT '##' || entry FROM entries)""",
    "places AS (SELECT word, unnest(range(length(word))) AS spot FROM types WHERE length(word) <= 100)",
    "cuts AS (SELECT word, spot, unnest(range(1, length(word) - spot + 1)) AS size FROM places)",
    """longest AS (
        SELECT word, spot, max(size) AS size
        FROM cuts JOIN vocab
          ON entry = CASE WHEN spot > 0 THEN '##' ELSE '' END || substr(word, spot + 1, size)
        GROUP BY word, spot)""",
    """walk AS (
        SELECT word, CAST(0 AS BIGINT) AS spot, CAST([] AS VARCHAR[]) AS parts FROM types
        UNION ALL
        SELECT walk.word, walk.spot + size,
               list_append(parts, CASE WHEN walk.spot > 0 THEN '##' ELSE '' END
                                  || substr(walk.word, walk.spot + 1, size))
        FROM walk JOIN longest ON walk.word = longest.word AND walk.spot = longest.spot)""",
    "done AS (SELECT word, parts FROM walk WHERE spot = length(word))",
    """coded AS (
        SELECT doc_id, line_no, flatten(list(coalesce(parts, ['[UNK]']) ORDER BY pos)) AS parts
        FROM tokens LEFT JOIN done USING (word) GROUP BY doc_id, line_no)""",
)
ORACLE["subword_longest_match"] = _with(
    *MATCHED,
    select="""SELECT doc_id, line_no, len(parts) AS n_tokens,
                     array_to_string(parts, ' ') AS tokens_text,
                     replace(array_to_string(parts, ' '), ' ##', '') AS text FROM coded""",
    recursive=True,
)

ORACLE["block_longest_match"] = _with(
    *MATCHED,
    select="""SELECT doc_id, line_no, len(parts[1:32]) AS n, array_to_string(parts[1:32], ' ') AS tokens_text
              FROM coded""",
    recursive=True,
)

ORACLE["bpe_decode"] = _with(LINES, select="SELECT doc_id, line_no, text FROM lines")

CURVE = (
    *MATCHED,
    _split(),
    f"""toks AS (
        SELECT split, doc_id, line_no, (doc_id * 31 + line_no) % 4 + 1 AS share, tokenizer, toks,
               CASE tokenizer WHEN 'char' THEN len(list_filter(toks, lambda t: t = ' ')) + 1
                              WHEN 'subword' THEN len(toks) - (length(marked) - length(replace(marked, '##', ''))) // 2
                              ELSE len(toks) END AS words
        FROM (SELECT *, '<BOS>' || array_to_string(toks, '') AS marked
              FROM (SELECT split, doc_id, line_no, tokenizer,
                           CASE tokenizer WHEN 'char' THEN {_chars()}
                                          WHEN 'space' THEN {_spaces()}
                                          WHEN 'word' THEN {_words()}
                                          ELSE coalesce(parts, CAST([] AS VARCHAR[])) END AS toks
                    FROM split LEFT JOIN coded USING (doc_id, line_no),
                         (VALUES ('char'), ('space'), ('word'), ('subword')) AS t(tokenizer)
                    WHERE split IN ('train', 'val'))))""",
    """wrapped AS (
        SELECT * EXCLUDE (toks), list_concat(['<BOS>'], toks, ['<EOS>']) AS toks FROM toks)""",
    _pairs("wrapped", "tokenizer, split, doc_id, line_no, share, words"),
    """weighed AS (SELECT *, words / (count(*) OVER (PARTITION BY tokenizer, doc_id, line_no)) AS weight FROM pairs)""",
    """two AS (
        SELECT epoch, tokenizer, prev, next,
               count(*) FILTER (split = 'train' AND share <= epoch) AS n,
               count(*) FILTER (split = 'train') AS everything,
               count(*) FILTER (split = 'val') AS m,
               sum(CASE WHEN split = 'val' THEN weight ELSE 0 END) AS weight
        FROM weighed, (VALUES (1), (2), (3), (4)) AS e(epoch) GROUP BY ALL)""",
    """one AS (
        SELECT epoch, tokenizer, next, sum(n) AS n, sum(everything) AS everything, sum(m) AS m, sum(weight) AS weight
        FROM two GROUP BY ALL)""",
    """sizes AS (
        SELECT epoch, tokenizer, count(*) AS v, sum(n) AS t, sum(everything) AS tr, sum(m) AS va FROM one GROUP BY ALL)""",
    "spoken AS (SELECT tokenizer, sum(words) AS words FROM toks WHERE split = 'val' GROUP BY tokenizer)",
    "prevs AS (SELECT epoch, tokenizer, prev, sum(n) AS t FROM two GROUP BY ALL)",
    """scored AS (
        SELECT 'bigram' AS model, epoch, tokenizer, everything, m, weight, -ln((n + 1.0::DOUBLE) / (prevs.t + v)) AS nll
        FROM two JOIN prevs USING (epoch, tokenizer, prev) JOIN sizes USING (epoch, tokenizer)
        UNION ALL
        SELECT 'unigram', epoch, tokenizer, everything, m, weight, -ln((n + 1.0::DOUBLE) / (t + v))
        FROM one JOIN sizes USING (epoch, tokenizer))""",
    """curve AS (
        SELECT model || '-' || tokenizer AS run, model, tokenizer, v AS vocab_size, va::BIGINT AS val_tokens,
               words::BIGINT AS val_words, tr::BIGINT AS train_tokens, epoch::BIGINT AS epoch,
               round(exp(sum(everything * nll) / tr), 6) AS train_ppl,
               round(exp(sum(m * nll) / va), 6) AS val_ppl,
               round(exp(round(sum(weight * nll) / words, 6)), 2) AS val_ppl_word_weighted,
               round(exp(round(sum(m * nll) / words, 6)), 2) AS val_ppl_word_normalised
        FROM scored JOIN sizes USING (epoch, tokenizer) JOIN spoken USING (tokenizer)
        GROUP BY model, epoch, tokenizer, v, tr, va, words)""",
)
ORACLE["experiment_curve"] = _with(*CURVE, select="SELECT * FROM curve", recursive=True)
ORACLE["experiment_best"] = _with(
    *CURVE,
    select="""
        SELECT run, count(*) AS n_epochs, max(epoch) AS last_epoch,
               arg_max(val_ppl, epoch) AS final_val_ppl, arg_max(train_ppl, epoch) AS final_train_ppl,
               min(val_ppl) AS best_val_ppl,
               (list(epoch ORDER BY val_ppl, epoch))[1] AS best_epoch
        FROM curve GROUP BY run""",
    recursive=True,
)
