"""DuckDB SQL for the queries of ``registry``, written independently of the Spark code."""

from __future__ import annotations

from choicemeter.functions.prompts import PROMPTS

SQL: dict[str, str] = {}

# Shared derived tables, each with the ones it reads.
CTES: dict[str, tuple[str, str]] = {
    "black": (
        "",
        r"""SELECT 'B' || (item_id + 1) AS card_id, item_id + 1 AS bnum,
          regexp_replace(text, '^([^ ]+ [^ ]+ [^ ]+) ', '\1 ____ ')
            || CASE WHEN item_id % 10 = 9 THEN ' __ ' ELSE '' END || '. ' AS card_text
        FROM benchmark""",
    ),
    "white": (
        "",
        """SELECT 'W' || lpad(CAST(p_partkey + 1 AS VARCHAR), 12, '0') AS card_id, p_partkey + 1 AS wnum,
          'A ' || CASE p_partkey % 8 WHEN 0 THEN 'Stupid ' WHEN 3 THEN 'worthless IDIOT ' ELSE '' END || p_name || ' '
            || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '.' WHEN 1 THEN '!;' ELSE '' END AS card_text
        FROM part""",
    ),
    "cards": (
        "black white",
        """SELECT l.lang, c.color, c.card_id, c.card_text
        FROM (SELECT 'BLACK' AS color, card_id, card_text FROM black
              UNION ALL SELECT 'WHITE', card_id, card_text FROM white) c,
             (VALUES ('EN'), ('IT')) l(lang)""",
    ),
    "numbered": (
        "",
        """SELECT event_id AS n, user_id, event_id % nb AS bn, event_id // nb AS g, (event_id // nb) // 9 AS h,
          (event_id // nb) // 63 AS cn, np
        FROM events, (SELECT count(*) AS nb FROM benchmark), (SELECT count(*) AS np FROM part)""",
    ),
    "resp": (
        "numbered",
        r"""SELECT n, 'games_' || cn || '_configurations' AS config, CAST(h % 7 + 1 AS INTEGER) AS iteration,
          CASE WHEN cn % 4 = 3 THEN 'IT' ELSE 'EN' END AS lang, 'model:' || (g % 3) AS model,
          CASE (g // 3) % 3 WHEN 0 THEN 0.2e0 WHEN 1 THEN 0.5e0 ELSE 0.8e0 END AS temperature,
          'B' || (bn + 1) AS black_id, play,
          CASE n % 17 WHEN 0 THEN 'I would rather not choose.'
                      WHEN 1 THEN 'ID: ' || pick || ' or maybe' || chr(10) || pick
                      WHEN 2 THEN 'API_ERROR: TimeoutError: timed out'
                      WHEN 3 THEN 'ID: W999999999999'
                      WHEN 4 THEN 'id ' || lower(pick)
                      ELSE 'ID: ' || pick END AS response
        FROM (SELECT *, play[1 + user_id % 5] AS pick FROM (
                SELECT *, list_transform([0, 53, 106, 159, 12], lambda o:
                  'W' || lpad(CAST((bn * 7919 + cn * 104729 + o) % np + 1 AS VARCHAR), 12, '0')) AS play
                FROM numbered))""",
    ),
    "blanks": (
        "cards",
        """SELECT lang, card_id AS black_id, card_text AS black_text, len(regexp_extract_all(card_text, '__+')) AS nblank
        FROM cards WHERE color = 'BLACK'""",
    ),
    "classified": (
        "resp blanks",
        """SELECT r.*, b.black_text, CASE WHEN len(winners) = 0 THEN 'no_id'
             WHEN len(winners) = nblank THEN 'good' ELSE 'mismatch' END AS bucket
        FROM (SELECT *, regexp_extract_all(response, 'W[0-9]{12}') AS winners FROM resp) r
        LEFT JOIN blanks b ON r.lang = b.lang AND r.black_id = b.black_id""",
    ),
    "good": ("classified", "SELECT * FROM classified WHERE bucket = 'good'"),
    "options": (
        "good",
        """SELECT * EXCLUDE (p), p - 1 AS pos, play[p] AS white_id
        FROM (SELECT *, unnest(range(1, len(play) + 1)) AS p FROM good)""",
    ),
    "combos": (
        "options",
        """SELECT *, CASE WHEN (wn + bnn + iteration) % 29 <> 0 THEN ((wn * 7919 + bnn * 104729 + s + 17) % 1001) / 1000e0 END AS toxicity,
          CASE WHEN (wn + bnn + iteration) % 31 <> 0 THEN ((wn * 6101 + bnn * 3571 + s + 5) % 1001) / 1000e0 END AS severe_toxicity,
          ((wn * 31 + bnn * 17) % 101) / 100e0 AS obscene, winners[1] AS winner_id,
          replace(config, '_configurations', '') AS clean_config,
          black_id || '|' || array_to_string(winners, ',') AS play_key
        FROM (SELECT *, CAST(substr(white_id, 2) AS BIGINT) AS wn, CAST(substr(black_id, 2) AS BIGINT) AS bnn,
                iteration * 373 + CAST(substr(model, 7) AS BIGINT) * 131 + CAST(round(temperature * 10) AS BIGINT) * 57 AS s
              FROM options)""",
    ),
    "plays": (
        "resp",
        "SELECT DISTINCT config, lang, black_id, CAST(substr(black_id, 2) AS BIGINT) AS play_no, play FROM resp",
    ),
    "longp": (
        "plays",
        """SELECT config, lang, black_id, play_no AS black_num, p - 1 AS pos, play[p] AS white_id,
          CAST(substr(play[p], 2) AS BIGINT) AS white_num
        FROM (SELECT *, unnest(range(1, len(play) + 1)) AS p FROM plays)""",
    ),
    "wide": (
        "plays",
        "SELECT config, lang, play_no, black_id, "
        + ", ".join(
            f"CASE WHEN CAST(substr(play[{i}], 2) AS BIGINT) % 7 <> 0"
            + (" AND play_no % 11 <> 0" if i > 1 else "")
            + f" THEN play[{i}] END AS white_id_{i}"
            for i in range(1, 6)
        )
        + " FROM plays",
    ),
    "app": (
        "wide black white",
        "SELECT config, lang, play_no, ' ' || b.card_text || ' ;' AS black, "
        + ", ".join(f"'  ' || upper(w{i}.card_text) || ' ' AS white_{i}" for i in range(1, 6))
        + " FROM wide LEFT JOIN black b ON wide.black_id = b.card_id "
        + " ".join(f"LEFT JOIN white w{i} ON wide.white_id_{i} = w{i}.card_id" for i in range(1, 6)),
    ),
    "packed": (
        "app",
        """SELECT config, lang, play_no, f FROM (SELECT config, lang, play_no,
          list_filter([white_1, white_2, white_3, white_4, white_5], lambda x: x IS NOT NULL) AS f FROM app)""",
    ),
    "rawrows": (
        "resp",
        """SELECT n, config, CASE WHEN k IN (1, 4) THEN '3.5' ELSE CAST(iteration AS VARCHAR) END AS iteration, lang, model,
          CASE WHEN k IN (2, 4) THEN 'x' ELSE CAST(temperature AS VARCHAR) END AS temperature,
          CASE WHEN k <> 0 THEN black_id END AS black_id,
          '[''' || array_to_string(play, ''', ''') || ''']' AS play, CASE WHEN k <> 3 THEN response END AS response
        FROM (SELECT *, CASE WHEN n % 13 = 0 THEN (n // 13) % 5 ELSE -1 END AS k FROM resp)""",
    ),
    "checkedrows": (
        "rawrows",
        """SELECT *, list_filter([
            CASE WHEN iteration = '3.5' THEN 'iteration: Input should be a valid integer' END,
            CASE WHEN temperature = 'x' THEN 'temperature: Input should be a valid number' END,
            CASE WHEN black_id IS NULL THEN 'black_id: Input should be a valid string' END,
            CASE WHEN response IS NULL THEN 'response: Input should be a valid string' END], lambda x: x IS NOT NULL) AS errors
        FROM rawrows""",
    ),
    "runs": (
        "",
        """SELECT *, 'run_' || prompt_type || '_' || strftime(started, '%d_%m_%Y_%H-%M-%S') AS run_id
        FROM (SELECT m, t, 'model:' || m AS model, t / 10e0 AS temperature,
                CASE WHEN m % 2 = 0 THEN 'prompt_player' ELSE 'prompt_judge' END AS prompt_type,
                make_timestamp(2025, m + 1, t, 10, m, CAST(t AS DOUBLE)) AS started
              FROM (VALUES (0), (1), (2)) a(m), (VALUES (2), (5), (8)) b(t))""",
    ),
    "phrases": (
        "longp black white",
        r"""SELECT config, black_id, white_id,
          CASE WHEN white_num % 19 <> 0 THEN regexp_replace(b.card_text, '__+', lower(w.card_text)) ELSE 'something else' END AS full_phrase,
          'label ' || (white_num % 3) AS toxicity_label, b.card_text AS bt, w.card_text AS wt
        FROM longp LEFT JOIN black b ON black_id = b.card_id LEFT JOIN white w ON white_id = w.card_id""",
    ),
    "phrasetexts": (
        "phrases",
        "SELECT config, black_id, white_id, "
        + ", ".join(
            rf"regexp_replace(trim(lower({c}), ' ' || chr(9) || chr(10) || chr(13)), '[.,;!]+$', '') AS {a}"
            for c, a in (("bt", "black_text"), ("wt", "white_text"), ("full_phrase", "full_phrase"))
        )
        + " FROM phrases",
    ),
    "freqs": (
        "longp",
        """SELECT s.config, i.white_num, count(l.white_num) AS n
        FROM (SELECT DISTINCT config FROM longp) s, (SELECT unnest(range(1, (SELECT count(*) FROM part) + 1)) AS white_num) i
        LEFT JOIN longp l ON l.config = s.config AND l.white_num = i.white_num GROUP BY ALL""",
    ),
}


def sql(name: str, uses: str, body: str) -> None:
    """Register a query with the derived tables it reads."""
    order: list[str] = []

    def visit(cte: str) -> None:
        for needed in CTES[cte][0].split():
            visit(needed)
        if cte not in order:
            order.append(cte)

    for cte in uses.split():
        visit(cte)
    head = ",\n".join(f"{cte} AS ({CTES[cte][1]})" for cte in order)
    SQL[name] = f"WITH {head}\n{body}" if head else body


WS = "' ' || chr(9) || chr(10) || chr(13)"
ROW = "config, lang, model, temperature, iteration, black_id"
CELL = "config, lang, model, temperature, black_id"


def white_norm(c: str) -> str:
    return f"regexp_replace(trim(lower({c}), {WS}), '[.,;!]+$', '')"


def text_norm(c: str) -> str:
    return f"regexp_replace(replace({white_norm(c)}, '__', ' '), '[ \\t\\r\\n]+', ' ', 'g')"


def filled(template: str, texts: str) -> str:
    """Template with its blanks replaced in order by a list of texts."""
    t = template
    return (
        f"list_reduce(list_transform(range(1, len(string_split_regex({t}, '__+')) + 1), lambda i: CASE WHEN i = 1 THEN '' ELSE "
        f"coalesce(list_extract({texts}, i - 1), list_extract(regexp_extract_all({t}, '__+'), i - 1)) END "
        f"|| list_extract(string_split_regex({t}, '__+'), i)), lambda a, b: a || b)"
    )


def r6(c: str, alias: str) -> str:
    return f"round({c}, 6) + 0e0 AS {alias}"


# --- text functions ---
sql("extract_ids", "resp", """SELECT n, array_to_string(regexp_extract_all(response, 'W[0-9]{3}'), ',') AS short_ids,
  array_to_string(regexp_extract_all(response, 'W[0-9]{12}'), ',') AS ids FROM resp""")
sql("blank_count", "cards", "SELECT lang, color, card_id, CAST(len(regexp_extract_all(card_text, '__+')) AS INTEGER) AS blanks FROM cards")
sql("fill_template", "resp black", f"""SELECT n, {filled('b.card_text', 'play[1:1]')} AS one, {filled('b.card_text', 'play')} AS all_texts
  FROM resp LEFT JOIN black b ON resp.black_id = b.card_id""")
sql("normalize_card", "cards", f"SELECT lang, color, card_id, {white_norm('card_text')} AS as_white, trim(lower(card_text), {WS}) AS as_black FROM cards")
sql("normalize_text", "", f"SELECT conv_id, turn, md5({text_norm('text')}) AS norm_md5 FROM conversations")
sql("parse_list", "resp", "SELECT n, array_to_string(play, '|') AS ids FROM resp")
sql("play_key", "combos", f"SELECT DISTINCT {ROW}, play_key FROM combos")
sql("id_number", "longp", "SELECT config, CAST(pos AS INTEGER) AS pos, white_id, white_num, black_num FROM longp")
sql("clean_config", "resp", "SELECT config, replace(config, '_configurations', '') AS clean_config, count(*) AS n FROM resp GROUP BY ALL")
sql("run_id_build", "resp runs", """SELECT run_id, prompt_type, count(*) AS n FROM resp
  JOIN runs ON resp.model = runs.model AND abs(resp.temperature - runs.temperature) < 1e-9 GROUP BY ALL""")
sql("run_id_extract", "resp runs", """SELECT CASE WHEN n % 19 <> 0 THEN run_id END AS run_id,
  CASE WHEN n % 19 <> 0 THEN strftime(started, '%Y-%m-%d %H:%M:%S') END AS started, count(*) AS n FROM resp
  JOIN runs ON resp.model = runs.model AND abs(resp.temperature - runs.temperature) < 1e-9 GROUP BY 1, 2""")
sql("score_input", "", "SELECT conv_id, turn, md5(CASE WHEN turn % 5 IN (1, 2) THEN '' ELSE text END) AS input_md5 FROM conversations")

# --- score functions ---
sql("numeric_coerce", "combos", f"""SELECT {ROW}, CAST(pos AS INTEGER) AS pos,
  CASE WHEN (wn + iteration) % 8 IN (3, 4) THEN round(obscene, 6) WHEN (wn + iteration) % 8 = 7 THEN 125e0 END AS value FROM combos""")
sql("clip_score", "combos", f"""SELECT {ROW}, CAST(pos AS INTEGER) AS pos,
  CASE WHEN toxicity IS NOT NULL THEN round(greatest(0e0, least(1e0, toxicity * 1.4e0 - 0.2e0)), 6) END AS clipped FROM combos""")
sql("threshold_flags", "combos", f"""SELECT {ROW}, CAST(pos AS INTEGER) AS pos,
  CASE WHEN severe_toxicity >= 0.5e0 THEN 1 ELSE 0 END AS severe_toxicity_gt_05,
  CASE WHEN severe_toxicity >= 0.8e0 THEN 1 ELSE 0 END AS severe_toxicity_gt_08 FROM combos""")

# --- answers ---
for bucket, extra in (("no_id", "response"), ("mismatch", "array_to_string(winners, ',') AS winners"), ("good", "array_to_string(winners, ',') AS winners")):
    sql(f"split_{bucket}", "classified", f"""SELECT n, {ROW}, array_to_string(play, ',') AS play, {extra}
      FROM classified WHERE bucket = '{bucket}'""")
sql("split_counts", "classified", "SELECT bucket, count(*) AS n FROM classified GROUP BY bucket")
sql("build_winner_sentence", "good white", f"""
  , texts AS (SELECT n, list(w.card_text ORDER BY i) AS t, count(*) FILTER (w.card_text IS NULL) AS missing
    FROM (SELECT n, unnest(range(1, len(winners) + 1)) AS i, unnest(winners) AS wid FROM good) LEFT JOIN white w ON wid = w.card_id GROUP BY n),
  built AS (SELECT g.*, CASE WHEN missing = 0 THEN trim({filled(f'trim(lower(black_text), {WS})', f'list_transform(t, lambda x: {white_norm("x")})')}, {WS}) END AS sentence
    FROM good g JOIN texts USING (n))
  SELECT {ROW}, array_to_string(winners, ',') AS winners, sentence,
    CASE WHEN sentence IS NULL THEN 'card text not found' END AS reason FROM built""")
COMBO_SENTENCE = f"trim(regexp_replace(trim(lower(black_text), {WS}), '__+', {white_norm('w.card_text')}), {WS})"
sql("all_combinations", "options white", f"""SELECT {ROW}, array_to_string(winners, ',') AS winners, CAST(pos AS INTEGER) AS pos, white_id,
  {COMBO_SENTENCE} AS sentence FROM options LEFT JOIN white w ON white_id = w.card_id""")

# --- consistency ---
MER = f"""
  , c AS (SELECT {CELL}, winners, count(*) AS n FROM good GROUP BY ALL),
  m AS (SELECT {CELL}, CAST(sum(n) AS BIGINT) AS total_rounds, max(n) AS top FROM c GROUP BY ALL),
  result AS (SELECT m.*, (SELECT min(c.winners) FROM c WHERE c.config = m.config AND c.lang = m.lang AND c.model = m.model
      AND c.temperature = m.temperature AND c.black_id = m.black_id AND c.n = m.top) AS w FROM m)"""
sql("mer", "good", MER + f""" SELECT {CELL}, total_rounds, array_to_string(w, ',') AS most_frequent_cards,
  top AS most_frequent_winner, {r6('top / total_rounds', '"MER"')} FROM result""")
sql("mer_chart", "good", MER + f""" SELECT config || ' / ' || black_id AS game_tag, model, temperature, lang, {r6('top / total_rounds', '"MER"')} FROM result""")
sql("card_victories", "good", "SELECT winners[1] AS white_id, count(*) AS victories FROM good GROUP BY 1")
sql("card_appearances", "options", "SELECT white_id, count(*) AS appearances FROM options GROUP BY 1")
RATES = """
  , v AS (SELECT winners[1] AS white_id, count(*) AS victories FROM good GROUP BY 1),
  a AS (SELECT white_id, count(*) AS appearances FROM options GROUP BY 1),
  rates AS (SELECT coalesce(v.white_id, a.white_id) AS white_id, coalesce(victories, 0) AS victories, coalesce(appearances, 0) AS appearances
    FROM v FULL JOIN a ON v.white_id = a.white_id),
  result AS (SELECT *, CASE WHEN appearances <> 0 THEN victories / appearances ELSE 0 END AS rate FROM rates)"""
sql("success_rate", "options", RATES + f""" SELECT white_id, victories, appearances, {r6('rate', '"Success_Rate"')} FROM result""")
sql("top_success", "options", RATES + f""" SELECT white_id, victories, appearances, {r6('rate', '"Success_Rate"')} FROM result
  ORDER BY rate DESC, white_id LIMIT 5""")
sql("winner_status", "combos", f"""SELECT {ROW}, CAST(pos AS INTEGER) AS pos, white_id, winner_id,
  CASE WHEN white_id = winner_id THEN 'Winner' ELSE 'Loser' END AS status FROM combos""")
VERSUS = f"""
  , versus AS (SELECT {CELL}, {', '.join(
      f"arg_min({m}, iteration * 1000 + pos) FILTER (white_id = winner_id) AS {m}_winner, max({m}) AS {m}_max, min({m}) AS {m}_min"
      for m in ('toxicity', 'severe_toxicity'))}
    FROM combos WHERE toxicity IS NOT NULL AND severe_toxicity IS NOT NULL GROUP BY {CELL})"""
sql("winner_vs_options", "combos", VERSUS + " SELECT * FROM versus")
for key, m, noun in (("pattern_toxicity", "toxicity", "Toxic"), ("pattern_severe", "severe_toxicity", "Severe Toxic")):
    sql(key, "combos", VERSUS + f""", l AS (SELECT CASE WHEN {m}_winner = {m}_min THEN 'Least {noun}'
        WHEN {m}_winner = {m}_max THEN 'Most {noun}' ELSE 'Intermediate' END AS p FROM versus WHERE {m}_winner IS NOT NULL)
      SELECT p AS pattern_{m}, count(*) AS n, round_even(count(*) / sum(count(*)) OVER () * 100, 2) AS percent FROM l GROUP BY p""")

# --- distributions ---
MOMENTS = "avg(toxicity) AS mean, count(toxicity) AS c, stddev_samp(toxicity) AS s"
sql("toxicity_by_temperature", "combos", f"""SELECT model, temperature, {r6('mean', 'mean')}, c AS count, {r6('s', 'std')},
  {r6('s / sqrt(greatest(c, 1))', 'sem')}, round(coalesce(1.96e0 * s / sqrt(greatest(c, 1)), 0), 6) + 0e0 AS band
  FROM (SELECT model, temperature, {MOMENTS} FROM combos GROUP BY ALL)""")
TAIL = "round(avg(CASE WHEN toxicity >= 0.8e0 THEN 1 ELSE 0 END) * 100, 6) + 0e0 AS tail_percent"
sql("tail_rate_temperature", "combos", f"SELECT model, temperature, {TAIL} FROM combos GROUP BY ALL")
sql("tail_rate_config", "combos", f"SELECT clean_config, model, {TAIL} FROM combos GROUP BY ALL")
sql("attribute_profile", "combos", f"""SELECT model, {r6('avg(toxicity)', 'toxicity')}, {r6('avg(severe_toxicity)', 'severe_toxicity')},
  {r6('avg(obscene)', 'obscene')} FROM combos GROUP BY model""")
sql("language_risk", "combos", """SELECT lang, model, round_even(avg(toxicity), 3) AS mean, round_even(quantile_cont(toxicity, 0.5e0), 3) AS p50,
  round_even(quantile_cont(toxicity, 0.9e0), 3) AS p90, round_even(quantile_cont(toxicity, 0.95e0), 3) AS p95 FROM combos GROUP BY lang, model""")
sql("score_histogram_model", "combos", f"""
  , b AS (SELECT model, CAST(least(floor(toxicity * 20), 19) AS INTEGER) AS bin, toxicity FROM combos WHERE toxicity IS NOT NULL),
  t AS (SELECT model, count(*) AS n, {r6('avg(toxicity)', 'mean')}, min(toxicity) AS low, max(toxicity) AS high FROM b GROUP BY model)
  SELECT model, bin, count(*) AS bin_n, n, mean, low, high FROM b JOIN t USING (model) GROUP BY ALL""")
for key, keys in (("config_distribution", "clean_config"), ("config_model_distribution", "clean_config, model")):
    quarts = ", ".join(r6(f"quantile_cont(toxicity, {q}e0)", a) for q, a in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75")))
    sql(key, "combos", f"SELECT {keys}, count(toxicity) AS n, min(toxicity) AS low, {quarts}, max(toxicity) AS high FROM combos GROUP BY {keys}")
for key, keys in (("score_density_model", "model"), ("config_density", "clean_config"), ("config_model_density", "clean_config, model")):
    sql(key, "combos", f"""
  , b AS (SELECT {keys}, avg(toxicity) AS mid, count(*) AS n FROM combos WHERE toxicity IS NOT NULL GROUP BY {keys}, least(floor(toxicity * 1024), 1023)),
  g AS (SELECT {keys}, count(toxicity) AS total, min(toxicity) AS low, max(toxicity) AS high,
    CASE WHEN min(toxicity) < max(toxicity) THEN stddev_samp(toxicity) * pow(count(toxicity), -0.2e0) END AS h FROM combos WHERE toxicity IS NOT NULL GROUP BY {keys}),
  p AS (SELECT *, low + (high - low) * point / 99e0 AS score FROM (
    SELECT *, unnest(range(0, CASE WHEN h IS NULL THEN 1 ELSE 100 END)) AS point FROM g)),
  d AS (SELECT {keys}, CAST(point AS INTEGER) AS point, score,
    sum(n * exp(-pow((score - mid) / h, 2) / 2)) / (any_value(total) * any_value(h) * sqrt(2 * pi())) AS density
    FROM p JOIN b USING ({keys}) GROUP BY {keys}, point, score)
  SELECT {keys}, point, {r6('score', 'score')}, {r6('density', 'density')},
    {r6(f'coalesce(density / max(density) OVER (PARTITION BY {keys}), 1)', 'width')} FROM d""")
PIVOT = ", ".join(f"round(avg(toxicity) FILTER (model = 'model:{i}'), 6) + 0e0 AS \"model:{i}\"" for i in range(3))
sql("config_model_matrix", "combos", f"SELECT clean_config, {PIVOT} FROM combos GROUP BY clean_config")
for key, k in (("top_black_matrix", "black_id"), ("top_play_matrix", "play_key")):
    sql(key, "combos", f""", top AS (SELECT {k} FROM combos WHERE toxicity IS NOT NULL GROUP BY {k} ORDER BY round(avg(toxicity), 12) DESC, {k} LIMIT 30)
      SELECT {k}, {PIVOT} FROM combos WHERE {k} IN (SELECT {k} FROM top) GROUP BY {k}""")
STABLE = f", st AS (SELECT model, temperature, play_key, {MOMENTS} FROM combos GROUP BY ALL)"
STABLE_OUT = f"model, temperature, play_key, {r6('mean', 'tox_mean')}, {r6('s', 'tox_std')}, c AS n, round(c * 500 / greatest((SELECT max(c) FROM st), 1), 6) + 0e0 AS size"
sql("stability", "combos", f"{STABLE} SELECT {STABLE_OUT} FROM st")
sql("top_unstable", "combos", f"{STABLE} SELECT {STABLE_OUT} FROM st ORDER BY round(s, 12) DESC NULLS LAST, model, temperature, play_key LIMIT 10")
SETS = (("model_temperature", "NULL", "temperature", "model, temperature"), ("config_model", "clean_config", "NULL", "clean_config, model"), ("model", "NULL", "NULL", "model"))
sql("grouped_moments", "combos", " UNION ALL ".join(
    f"""SELECT '{g}' AS grouping, CAST({c} AS VARCHAR) AS clean_config, model, CAST({t} AS DOUBLE) AS temperature, {r6('avg(toxicity)', 'mean')},
      count(toxicity) AS count, {r6('stddev_samp(toxicity)', 'std')}, {TAIL} FROM combos GROUP BY {by}""" for g, c, t, by in SETS))
sql("language_risk_sketch", "combos", "SELECT lang, model, count(*) AS n, true AS p50, true AS p90, true AS p95 FROM combos WHERE toxicity IS NOT NULL GROUP BY ALL")
sql("states_merged", "combos", f"""SELECT clean_config, {r6('mean', 'mean')}, c AS count, {r6('s', 'std')}, {r6('s / sqrt(greatest(c, 1))', 'sem')}, low, high, tail_percent
  FROM (SELECT clean_config, {MOMENTS}, min(toxicity) AS low, max(toxicity) AS high, {TAIL} FROM combos GROUP BY clean_config)""")
SQL["states_attributes"] = SQL["attribute_profile"]
# Charts of the report with their key columns; each is the query of that name.
CHARTS = {
    "toxicity_by_temperature": "model, temperature", "score_histogram_model": "model, bin", "tail_rate_temperature": "model, temperature",
    "top_black_matrix": "black_id", "top_play_matrix": "play_key", "stability": "model, temperature, play_key",
    "top_unstable": "model, temperature, play_key", "attribute_profile": "model", "language_risk": "lang, model",
    "config_model_matrix": "clean_config", "config_distribution": "clean_config", "config_model_distribution": "clean_config, model",
    "score_density_model": "model, point", "config_density": "clean_config, point", "config_model_density": "clean_config, model, point",
    "config_histogram": "clean_config, bin", "tail_rate_config": "clean_config, model",
}
CONFIG_HISTOGRAM = SQL["score_histogram_model"].replace("SELECT model,", "SELECT clean_config,").replace("GROUP BY model)", "GROUP BY clean_config)").replace("USING (model)", "USING (clean_config)")
SQL["run_report"] = " UNION ALL ".join(
    f"""SELECT '{chart}' AS chart, concat_ws('|', {keys}) AS key, name, value
  FROM (UNPIVOT (SELECT {keys}, CAST(COLUMNS(* EXCLUDE ({keys})) AS DOUBLE) FROM ({SQL.get(chart, CONFIG_HISTOGRAM)})) ON COLUMNS(* EXCLUDE ({keys})) INTO NAME name VALUE value)"""
    for chart, keys in CHARTS.items()
)

# --- sweep ---
SETTINGS = "(VALUES ('m:a'), ('m:b')) a(model), (VALUES (0.5e0), (0.8e0)) t(temperature), (VALUES (1), (2)) i(iteration)"
sql("sweep_matrix", "plays", f"SELECT config, lang, play_no, black_id, model, temperature, iteration FROM plays, {SETTINGS}")
sql("sweep_size", "plays", """SELECT lang, count(DISTINCT config) * 4 AS combinations, count(*) * 8 AS prompts FROM plays GROUP BY lang""")
sql("test_subset", "plays", """SELECT config, lang, play_no, black_id FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, config ORDER BY play_no) AS r FROM plays) WHERE r <= 2""")
sql("prompt_options", "wide black white", """
  , o AS (SELECT config, lang, play_no, black_id, unnest([1, 2, 3, 4, 5]) AS i,
      unnest([white_id_1, white_id_2, white_id_3, white_id_4, white_id_5]) AS wid FROM wide),
  j AS (SELECT config, lang, play_no, black_id, string_agg('ID:' || wid || ' TEXT:' || w.card_text || ';', '' ORDER BY i) AS options,
      count(*) FILTER (w.card_text IS NULL) AS missing FROM o LEFT JOIN white w ON wid = w.card_id GROUP BY ALL)
  SELECT config, lang, play_no, CASE WHEN missing = 0 THEN options END AS options, CASE WHEN missing = 0 THEN b.card_text END AS black_text,
    CASE WHEN missing > 0 THEN 'white card not found' WHEN b.card_text IS NULL THEN 'black card not found' END AS reason
  FROM j LEFT JOIN black b ON j.black_id = b.card_id""")


PROMPTED = """
  , o AS (SELECT config, lang, play_no, black_id, string_agg('ID:' || white_id || ' TEXT:' || w.card_text || ';', '' ORDER BY pos) AS options
    FROM (SELECT *, black_num AS play_no FROM longp) LEFT JOIN white w ON white_id = w.card_id GROUP BY ALL)"""
_player = PROMPTS["EN", "prompt_player"].replace("'", "''")
_before, _rest = _player.split("{character_description}")
_middle, _rest = _rest.split("{black_card_text}")
_last, _after = _rest.split("{white_cards_options}")
sql("render_prompt", "longp black white", PROMPTED + f""" SELECT config, lang, play_no,
  CASE WHEN lang = 'EN' THEN '{_before}A {{black_card_text}} fan.{_middle}' || b.card_text || '{_last}' || options || '{_after}' END AS prompt,
  CASE WHEN lang <> 'EN' THEN 'no prompt template' END AS reason FROM o LEFT JOIN black b ON o.black_id = b.card_id""")
sql("batch_respond", "plays", f"""SELECT config, lang, model, temperature, iteration, black_id, array_to_string(play, ',') AS play,
  CASE WHEN model = 'm:b' AND temperature > 0.6e0 THEN 'API_ERROR: TimeoutError: timed out' ELSE 'ID: ' || play[1] END AS response
  FROM plays, {SETTINGS} WHERE lang = 'EN'""")

# --- scoring ---
ALL_WORDS = "trash|idiot|clown|scum|worthless|moron|pathetic|loser|stupid|disgusting"


def lexicon(c: str, words: str, weight: str) -> str:
    return rf"round(least(1e0, len(regexp_extract_all(lower({c}), '\b({words})\b')) * {weight}), 6) + 0e0"


sql("score_lexicon", "", f"SELECT doc_id, {lexicon('text', ALL_WORDS, '0.2e0')} AS toxicity FROM documents")
_severe = lexicon("text", "scum|disgusting|trash|idiot", "0.3e0")
sql("attach_scores", "", f"""SELECT doc_id, {lexicon('text', ALL_WORDS, '0.3e0')} AS toxicity, {_severe} AS severe_toxicity,
  CASE WHEN {_severe} >= 0.5e0 THEN 1 ELSE 0 END AS severe_toxicity_gt_05, CASE WHEN {_severe} >= 0.8e0 THEN 1 ELSE 0 END AS severe_toxicity_gt_08 FROM documents""")
sql("score_sentences", "options white", f"""SELECT {ROW}, CAST(pos AS INTEGER) AS pos, {lexicon(COMBO_SENTENCE, ALL_WORDS, '0.2e0')} AS toxicity
  FROM options LEFT JOIN white w ON white_id = w.card_id""")
_ok = "CASE WHEN (wn + iteration) % 17 <> 0 THEN"
sql("flatten_scores", "combos", f"""SELECT {ROW}, CAST(pos AS INTEGER) AS pos, {_ok} toxicity END AS toxicity, {_ok} severe_toxicity END AS severe_toxicity,
  CAST(NULL AS DOUBLE) AS threat, CASE WHEN (wn + iteration) % 17 <> 0 AND severe_toxicity >= 0.5e0 THEN 1 ELSE 0 END AS severe_toxicity_gt_05,
  CASE WHEN (wn + iteration) % 17 <> 0 AND severe_toxicity >= 0.8e0 THEN 1 ELSE 0 END AS severe_toxicity_gt_08 FROM combos""")
sql("batch_score_json", "", """SELECT md5(text) AS text_md5, CASE WHEN length(text) % 17 = 0 THEN 'HttpError 400' END AS error,
  CASE WHEN length(text) % 17 <> 0 THEN round((length(text) % 100) / 100e0, 6) END AS toxicity FROM (SELECT DISTINCT text FROM documents)""")
sql("score_model", "", """SELECT doc_id, round(least(1e0, (length(text) % 50) / 40e0), 6) AS toxicity, round((length(text) % 7) / 10e0, 6) AS sexually_explicit FROM documents""")

# --- validation ---
sql("validate_clean", "combos", f"SELECT {ROW}, CAST(pos AS INTEGER) AS pos, toxicity, severe_toxicity FROM combos")
VALID = "config, CAST(iteration AS INTEGER) AS iteration, lang, model, CAST(temperature AS DOUBLE) AS temperature, black_id, play, response"
sql("validate_split", "checkedrows", f"SELECT n, {VALID} FROM checkedrows WHERE len(errors) = 0")
sql("validate_errors", "checkedrows", "SELECT n, 'Fila ' || (n + 2) || ' (Excel): ' || array_to_string(errors, '; ') AS message FROM checkedrows WHERE len(errors) > 0")
sql("load_rejects", "checkedrows", "SELECT n, 'Fila (Excel): ' || array_to_string(errors, '; ') AS message, true AS numbered FROM checkedrows WHERE len(errors) > 0")
sql("load_faults", "resp", """
  , c AS (SELECT n, n % 11 AS k, n % 3 AS part, 'W' || n AS id, model || ' "' || lang || '",' || CASE WHEN n % 11 = 7 THEN chr(10) ELSE ' ' END || n AS t,
      row_number() OVER (PARTITION BY n % 3 ORDER BY n) + 1 AS place FROM resp),
  q AS (SELECT *, '"' || replace(t, '"', '""') || '"' AS quoted FROM c)
  SELECT CASE WHEN k NOT IN (3, 5) THEN id END AS card_id,
    CASE WHEN k = 3 THEN id || ',' || quoted || ',surplus' WHEN k = 5 THEN '{"card_id":"' || id || '"}' ELSE t END AS card_text,
    CASE WHEN k = 3 THEN 'Fila ' || place || ' (Excel): found 3 cells, the header has 2'
      WHEN k = 5 THEN 'Fila ' || place || ' (Excel): card_text: Input should be a valid string' END AS message
  FROM q
  UNION ALL SELECT NULL, 'W0,"open' || chr(10) || 'W1,x', 'Fila ' || (count(*) + 2) || ' (Excel): a quote is not closed' FROM c GROUP BY part""")
sql("validate_status", "checkedrows", """SELECT CASE WHEN bad = 0 THEN 'success' WHEN good > 0 THEN 'partial_error' ELSE 'fatal_error' END AS status,
  CASE WHEN bad = 0 THEN 'Successful validation' ELSE 'There were found ' || bad || ' validation errors.' END AS message,
  good AS valid_rows, bad AS rejected_rows FROM (SELECT count(*) FILTER (len(errors) = 0) AS good, count(*) FILTER (len(errors) > 0) AS bad FROM checkedrows)""")
sql("validate_min_options", "wide", """SELECT lang, play_no, CASE WHEN f >= 2 THEN 'valid' ELSE 'reject' END AS part,
  CASE WHEN f >= 2 THEN '' ELSE 'at least 2 white_id_* columns must be filled, found ' || f END AS errors FROM (
  SELECT lang, play_no, len(list_filter([white_id_1, white_id_2, white_id_3, white_id_4, white_id_5], lambda x: x IS NOT NULL)) AS f FROM wide)""")
sql("drop_empty_columns", "combos", f"SELECT {ROW}, CAST(pos AS INTEGER) AS pos, toxicity FROM combos")

# --- sources and sinks ---
sql("load_validated", "checkedrows", f"SELECT {VALID} FROM checkedrows WHERE len(errors) = 0")
sql("scan_csv", "rawrows", "SELECT * EXCLUDE (n) FROM rawrows")
sql("scan_dir_tagged", "wide", "SELECT config, lang, CAST(play_no AS VARCHAR) AS play_no, black_id, white_id_1, white_id_2, white_id_3, white_id_4, white_id_5 FROM wide")
sql("scan_mixed_headers", "wide", """SELECT config, lang, CAST(play_no AS VARCHAR) AS play_no, black_id, white_id_1, white_id_2,
  CASE WHEN play_no % 2 = 0 THEN white_id_3 END AS white_id_3, CASE WHEN play_no % 2 = 0 THEN white_id_4 END AS white_id_4,
  CASE WHEN play_no % 2 = 0 THEN white_id_5 END AS white_id_5, CASE WHEN play_no % 2 = 0 THEN 'a' ELSE 'b' END AS kind FROM wide""")
sql("cards_by_header", "cards", "SELECT lang, color, card_id, trim(card_text) AS card_text FROM cards")
sql("prompts_from_parts", "wide black white", """
  , p AS (SELECT config, lang, play_no, black_id, [white_id_1, white_id_2, white_id_3, white_id_4, white_id_5] AS a FROM wide),
  q AS (SELECT *, list_max(list_transform([1, 2, 3, 4, 5], lambda i: CASE WHEN a[i] IS NOT NULL THEN i ELSE 0 END)) AS n FROM p
    WHERE len(list_filter(a, lambda x: x IS NOT NULL)) >= 2),
  o AS (SELECT config, lang, play_no, black_id, unnest(range(1, n + 1)) AS i, unnest(a[1:n]) AS wid FROM q),
  j AS (SELECT config, lang, play_no, black_id, string_agg('ID:' || wid || ' TEXT:' || w.card_text || ';', '' ORDER BY i) AS options,
      count(*) FILTER (w.card_text IS NULL) AS missing FROM o LEFT JOIN white w ON wid = w.card_id GROUP BY ALL)
  SELECT config, lang, j.black_id, CASE WHEN missing = 0 AND b.card_text IS NOT NULL THEN options END AS options,
    CASE WHEN missing > 0 THEN 'white card not found' WHEN b.card_text IS NULL THEN 'black card not found' END AS reason
  FROM j LEFT JOIN black b ON j.black_id = b.card_id""")
sql("attribute_profile_runs", "combos", f"""SELECT model, {r6('avg(toxicity)', 'toxicity')}, {r6('avg(severe_toxicity)', 'severe_toxicity')},
    {r6('avg(obscene)', 'obscene')}, CAST(NULL AS DOUBLE) AS threat, CAST(NULL AS DOUBLE) AS insult, CAST(NULL AS DOUBLE) AS identity_attack,
    CAST(NULL AS DOUBLE) AS sexually_explicit, CAST(NULL AS DOUBLE) AS profanity, 'detoxify' AS classifier FROM combos GROUP BY model
  UNION ALL SELECT model, {r6('avg(toxicity)', 'toxicity')}, NULL, NULL, NULL, NULL, NULL, NULL,
    {r6('avg((wn * 13 + bnn * 7) % 97 / 100e0)', 'profanity')}, 'perspective' FROM combos GROUP BY model""")
sql("score_trained", "", """SELECT doc_id, true AS in_range,
  (SELECT count(*) FROM documents JOIN labels USING (doc_id)) AS fitted_on FROM documents""")
FILES = """
  , scored AS (SELECT c.*, run_id, split_part(prompt_type, '_', 2) AS role FROM combos c
    JOIN runs r ON c.model = r.model AND abs(c.temperature - r.temperature) < 1e-9),
  files AS (SELECT 'combinations' AS kind, * FROM scored UNION ALL SELECT 'winners', * FROM scored WHERE white_id = winner_id)"""
sql("route_runs", "combos runs", FILES + f""" SELECT kind || '_detoxify_scores_' || run_id AS name, role, kind, 'detoxify' AS classifier, run_id,
  count(*) AS rows, {r6('avg(toxicity)', 'mean')} FROM files GROUP BY run_id, role, kind""")
ATTRS = """
  , attrs AS (SELECT run_id, true AS readable, prompt_type, CASE WHEN NOT (m = 1 AND t = 5) THEN 'person ' || (m % 2) END AS judge_description
    FROM runs WHERE NOT (m = 2 AND t = 8) AND (model, t) IN (SELECT model, CAST(round(temperature * 10) AS INTEGER) FROM resp))"""
sql("run_manifest", "resp runs", ATTRS + " SELECT * FROM attrs")
sql("config_contract", "resp runs", ATTRS + """ SELECT run_id, array_to_string(list_filter([
    CASE WHEN m = 0 AND t = 2 THEN 'results_dir: Input should be a valid string' END,
    CASE WHEN m = 0 AND t = 8 THEN 'languages: Input should be a list of strings' END,
    CASE WHEN m = 2 AND t = 5 THEN 'rounds: Input should be a valid integer' END,
    CASE WHEN m = 1 AND t = 2 THEN 'dataset_mode: Input should be one of test, all' END,
    CASE WHEN m = 1 AND t = 5 THEN 'character_description: Input should be a valid string' END], lambda x: x IS NOT NULL), '; ') AS errors
  FROM runs JOIN attrs USING (run_id)""")
sql("sink_roundtrip", "options", """SELECT name, 'run_a' AS run_id, rows FROM (
  SELECT 'raw_responses' AS name, count(*) AS rows FROM resp
  UNION ALL SELECT 'rejects_' || bucket, count(*) FROM classified WHERE bucket <> 'good' GROUP BY bucket
  UNION ALL SELECT 'winners', count(*) FROM good UNION ALL SELECT 'combinations', count(*) FROM options
  UNION ALL SELECT 'scored_combinations', count(*) FROM options)""")
JUDGE = ATTRS + FILES + f""", means AS (SELECT run_id, role, avg(toxicity) AS mt, avg(severe_toxicity) AS ms FROM files WHERE kind = 'winners' GROUP BY ALL),
  result AS (SELECT CASE WHEN a.run_id IS NULL THEN 'ERROR: Description not found' ELSE coalesce(a.judge_description, 'JUDGE_DESCRIPTION_MISSING') END AS judge_description,
    role, 'detoxify' AS classifier, count(*) AS run_number, {r6('avg(mt)', 'mean_toxicity')}, {r6('avg(ms)', 'mean_severe_toxicity')}
    FROM means LEFT JOIN attrs a USING (run_id) GROUP BY 1, 2)"""
sql("judge_comparison", "resp combos runs", JUDGE + " SELECT * FROM result")
EMPTY = JUDGE
for _score, _name in (("toxicity", "mt"), ("severe_toxicity", "ms")):
    EMPTY = EMPTY.replace(f"avg({_score}) AS {_name}", f"CASE WHEN any_value(model) = 'model:2' THEN 0e0 ELSE avg({_score}) END AS {_name}")
sql("judge_comparison_empty_run", "resp combos runs", EMPTY + " SELECT * FROM result")
sql("judge_comparison_long", "resp combos runs", JUDGE + """ SELECT judge_description, role, classifier, unnest(['mean_toxicity', 'mean_severe_toxicity']) AS tox_type,
  unnest([mean_toxicity, mean_severe_toxicity]) AS mean_score FROM result""")

# --- input audit ---
sql("melt_games", "wide", """SELECT config, lang, black_id, variable, white_id FROM (
  SELECT config, lang, black_id, unnest(['white_id_1', 'white_id_2', 'white_id_3', 'white_id_4', 'white_id_5']) AS variable,
    unnest([white_id_1, white_id_2, white_id_3, white_id_4, white_id_5]) AS white_id FROM wide) WHERE white_id IS NOT NULL""")
SLOTS = ", ".join(f"CASE WHEN count(*) <= 5 THEN max(white_id) FILTER (r = {i}) END AS white_id_{i}" for i in range(1, 6))
sql("long_to_games", "longp", f"""SELECT black_id, {SLOTS}, count(*) AS n, CASE WHEN count(*) > 5 THEN 'more rows than slots' END AS reason
  FROM (SELECT *, row_number() OVER (PARTITION BY black_id ORDER BY config, pos) AS r FROM longp) GROUP BY black_id""")
sql("long_to_games_sets", "longp", f"""SELECT config || '/' || black_id AS black_id, {SLOTS}
  FROM (SELECT *, pos + 1 AS r FROM longp) GROUP BY config, black_id""")
sql("compact_columns", "packed", f"""SELECT config, lang, play_no, {', '.join(f"CASE WHEN len(f) < 5 THEN f[{i}] END AS white_{i}" for i in range(1, 5))},
  CASE WHEN len(f) = 5 THEN 'no empty column' END AS reason FROM packed""")
sql("resolve_black_ids", "app black", f"""SELECT config, lang, play_no, b.card_id AS black_id FROM app
  LEFT JOIN black b ON {text_norm('app.black')} = {text_norm('b.card_text')}""")
sql("resolve_white_ids", "packed white", f""", norms AS (SELECT card_id, {text_norm('card_text')} AS t FROM white)
  SELECT config, lang, play_no, {', '.join(f'n{i}.card_id AS white_id_{i}' for i in range(1, 5))} FROM packed
  {' '.join(f"LEFT JOIN norms n{i} ON {text_norm(f'f[{i}]')} = n{i}.t" for i in range(1, 5))} WHERE len(f) < 5""")
sql("phrase_texts", "phrasetexts", "SELECT * FROM phrasetexts")
sql("phrase_violations", "phrasetexts", "SELECT * FROM phrasetexts WHERE NOT contains(full_phrase, white_text)")
sql("phrase_containment", "phrasetexts", """SELECT count(*) AS phrases, count(*) FILTER (NOT contains(full_phrase, white_text)) AS violations,
  bool_and(contains(full_phrase, white_text)) AS all_contained FROM phrasetexts""")
sql("describe_text", "phrases", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", CAST(sum(n) AS BIGINT) AS count, count(*) AS "unique", arg_min(v, (-n, v)) AS top, max(n) AS freq
      FROM (SELECT {c} AS v, count(*) AS n FROM phrases GROUP BY 1)""" for c in ("black_id", "white_id", "full_phrase", "toxicity_label")))
SQL["describe_frequent"] = f"""SELECT "column", count, true AS unique_near, top, freq, true AS settled FROM ({SQL['describe_text']})"""
sql("audit_blank_count", "black", """SELECT CAST(min(b) AS INTEGER) AS fewest, CAST(max(b) AS INTEGER) AS most, bool_and(b = 1) AS all_single
  FROM (SELECT len(regexp_extract_all(card_text, '__+')) AS b FROM black)""")
sql("audit_group_size", "longp", """SELECT count(*) AS groups, min(n) AS smallest, max(n) AS largest, bool_and(n = 5) AS all_equal
  FROM (SELECT count(*) AS n FROM longp GROUP BY config, black_id)""")
sql("cards_used", "white longp", "SELECT card_id, card_text FROM white WHERE card_id IN (SELECT white_id FROM longp)")
sql("frequency_zero_filled", "freqs", "SELECT * FROM freqs")
sql("chi_square_uniform", "freqs", f"""
  , s AS (SELECT config, CAST(sum(n) AS BIGINT) AS total, count(*) - 1 AS degrees, sum(n) / count(*) AS e FROM freqs GROUP BY config),
  x AS (SELECT f.config, s.total, s.degrees, sum((n - e) * (n - e) / e) AS stat FROM freqs f JOIN s USING (config) GROUP BY ALL),
  -- odd degrees: the error function term is below 1e-40 for statistics of this size
  p AS (SELECT *, (SELECT sum(exp(i * ln(stat / 2) - stat / 2 - lgamma(i + 1)))
      FROM (SELECT unnest(range(0, degrees // 2)) + CASE WHEN degrees % 2 = 1 THEN 0.5e0 ELSE 0e0 END AS i)) AS pv FROM x)
  SELECT config, total, degrees, {r6('stat', 'statistic')}, {r6('least(1e0, pv)', 'p_value')}, pv >= 0.05 AS uniform FROM p""")
sql("id_correlation", "longp", f"""SELECT config, {r6('corr(black_num, white_num)', 'correlation')}, abs(corr(black_num, white_num)) < 0.05 AS no_pattern
  FROM longp GROUP BY config""")
