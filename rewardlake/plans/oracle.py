"""DuckDB oracle SQL, one statement per registered query.

The stand-in inputs are re-derived here in SQL (FIXTURES.md part C) so
that the oracle shares no code with the Spark side.
"""
from __future__ import annotations

VIEWS: dict[str, str] = {
    "rollouts": """
rollouts AS (
  SELECT CASE WHEN user_id % 2 = 0 THEN 'base' ELSE 'variant' END AS run_id,
         CAST(user_id * 1000 + rn // 12 AS BIGINT) AS step,
         CAST((rn % 12) // 3 AS INTEGER) AS g,
         CAST(rn % 3 AS INTEGER) AS turn,
         least(floor(value / 50), 3) / 3.0 AS reward,
         least(floor(value / 50), 3) / 3.0 >= 1 AS solved,
         event_id
  FROM (SELECT event_id, user_id, value,
               row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS rn
        FROM events))""",
    "run_config": """
run_config AS (
  SELECT run_id, variant_fixes, group_size, max_turns,
         CAST(epsilon_low AS DOUBLE) AS epsilon_low, CAST(epsilon_high AS DOUBLE) AS epsilon_high,
         CAST(kl_coeff AS DOUBLE) AS kl_coeff, CAST(temperature AS DOUBLE) AS temperature,
         CAST(temp_stage1 AS DOUBLE) AS temp_stage1, CAST(temp_stage2 AS DOUBLE) AS temp_stage2,
         temp_switch_step, CAST(mask_prob AS DOUBLE) AS mask_prob, repeat_check_len, reward_mode,
         scale_rewards, eval_every
  FROM (VALUES
    ('base', false, 4, 3, 0.2, 0.2, 0.01, 0.8, 0.7, 1.0, 100, 0.3, 128, 'final', true, 50),
    ('variant', true, 4, 3, 0.2, 0.5, 0.0, 0.8, 0.7, 1.0, 100, 0.3, 128, 'best', false, 50))
  AS t(run_id, variant_fixes, group_size, max_turns, epsilon_low, epsilon_high, kl_coeff, temperature,
       temp_stage1, temp_stage2, temp_switch_step, mask_prob, repeat_check_len, reward_mode,
       scale_rewards, eval_every))""",
}

# Trajectory summary shared by several oracle statements.
VIEWS["trajs"] = """
turns_cfg AS (
  SELECT r.*, c.group_size, c.max_turns, c.reward_mode, c.scale_rewards, c.variant_fixes
  FROM rollouts r JOIN run_config c USING (run_id)),
marked AS (
  SELECT *, (solved OR turn + 1 >= max_turns) AS done,
         max(CASE WHEN solved OR turn + 1 >= max_turns THEN 1 ELSE 0 END) OVER (
           PARTITION BY run_id, step, g ORDER BY turn
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_done
  FROM turns_cfg),
kept AS (SELECT * FROM marked WHERE coalesce(prior_done, 0) = 0 AND turn < max_turns),
trajs AS (
  SELECT run_id, step, g, group_size, reward_mode, scale_rewards,
         coalesce(arg_max(reward, turn), 0.0) AS final_reward,
         coalesce(max(reward), 0.0) AS best_reward,
         coalesce(bool_or(solved), false) AS solved,
         count(*) AS n_turns,
         CASE WHEN reward_mode = 'best' THEN coalesce(max(reward), 0.0)
              ELSE coalesce(arg_max(reward, turn), 0.0) END AS reward
  FROM kept GROUP BY run_id, step, g, group_size, reward_mode, scale_rewards),
adv AS (
  SELECT *, CASE WHEN scale_rewards THEN
              CASE WHEN stddev_samp(reward) OVER w > 1e-6
                   THEN (reward - avg(reward) OVER w) / (stddev_samp(reward) OVER w + 1e-8)
                   ELSE 0.0 END
            ELSE reward - avg(reward) OVER w END AS advantage
  FROM trajs WINDOW w AS (PARTITION BY run_id, step))"""

VIEW_DEPS = {"trajs": ("rollouts", "run_config"), "verdicts": ("test_results", "comps"),
             "logprobs": ("lp_base",), "hourly": ("step_log",), "pairs": ("eval_results",),
             "p1": ("eval_results",), "tasks_named": ("tasks",), "task_rows": ("tasks_named",)}


def sql_str(text: str) -> str:
    """A SQL string literal; newlines as chr(10)."""
    parts = ["'" + p.replace("'", "''") + "'" for p in text.split("\n")]
    return " || chr(10) || ".join(parts)


# The five commit states (same literals as the Spark fixture).
_CODES = ("import os", "def f(x):\n    return x", "def f(x) return x",
          "import os\ndef f(x):\n    return x",
          "import os\nimport sys\n\nclass Runner:\n    pass\n\n"
          "def run(values):\n    total = sum(values)\n    return total * 2\n")
NL = "chr(10)"
STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
ENTRY_LOOSE = "coalesce(list_filter(list_transform({t}, lambda t: regexp_extract(t, '\\bassert\\s+(\\w+)\\s*\\(', 1)), lambda x: x <> '')[1], '')"
ENTRY_STRICT = "list_filter(list_transform({t}, lambda t: regexp_extract(t, 'assert\\s+([A-Za-z_]\\w*)\\s*\\(', 1)), lambda x: x <> '')[1]"
RFT_SYS = ("You are an expert Python programmer. Write a single, correct, self-contained "
           "Python function that solves the problem. Respond with only the function inside "
           "a ```python code block.")
V1_SYS = ("You are an expert Python programmer. Write ONLY the Python function. "
          "No markdown, no code fences, no explanations.")
FIRST_TURN = ("'Solve this Python task. The function must be named `' || {e} || '`.' || chr(10) || chr(10) || {p}")

VIEWS.update({
    "test_results": """
test_results AS (
  SELECT l_orderkey AS completion_id, l_linenumber AS test_idx, l_quantity > 25 AS passed
  FROM lineitem)""",
    "comps": """
comps AS (
  SELECT o_orderkey AS completion_id, o_orderstatus <> 'P' AS syntax_ok,
         o_orderpriority = '1-URGENT' AS has_fence
  FROM orders)""",
    "verdicts": """
cnt AS (SELECT completion_id, sum(CAST(passed AS INTEGER)) AS n_passed, count(*) AS n_total
        FROM test_results GROUP BY completion_id),
v0 AS (SELECT c.completion_id, c.syntax_ok, c.has_fence,
              CAST(coalesce(n_total, 0) AS BIGINT) AS n_total,
              CAST(CASE WHEN c.syntax_ok THEN coalesce(n_passed, 0) ELSE 0 END AS BIGINT) AS n_passed
       FROM comps c LEFT JOIN cnt USING (completion_id)),
verdicts AS (
  SELECT *, CASE WHEN n_total > 0 THEN n_passed / n_total ELSE 0.0 END AS fraction_passed,
         n_total > 0 AND n_passed = n_total AS all_passed
  FROM v0)""",
    "lp_base": """
lp_base AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: -30.0 * abs(CAST(x AS DOUBLE))) AS lp
  FROM embeddings)""",
    "logprobs": """
logprobs AS (
  SELECT b.vec_id, b.label AS grp, (b.vec_id % 5 - 2) / 2.0 AS adv, b.lp, o.lp AS old_lp, r.lp AS ref_lp
  FROM lp_base b
  JOIN lp_base o ON o.vec_id = (b.vec_id + 1) % (SELECT count(*) FROM embeddings)
  JOIN lp_base r ON r.vec_id = (b.vec_id + 2) % (SELECT count(*) FROM embeddings))""",
    "tokens": """
tokens AS (
  SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ids
  FROM documents)""",
    "texts": """
texts AS (
  SELECT source AS grp, text FROM documents
  UNION ALL SELECT 'conv' || CAST(conv_id AS VARCHAR), text FROM conversations WHERE role = 'assistant'
  UNION ALL SELECT 'short', 'too short here')""",
    "eval_results": """
eval_results AS (
  SELECT 'base' AS label, CASE WHEN doc_id % 2 = 0 THEN 'in_dist' ELSE 'transfer' END AS axis,
         'task/' || CAST(doc_id AS VARCHAR) AS task_id, quality = 1 AS passed FROM labels
  UNION ALL
  SELECT 'A', CASE WHEN doc_id % 2 = 0 THEN 'in_dist' ELSE 'transfer' END,
         'task/' || CAST(doc_id AS VARCHAR), toxic = 0 FROM labels
  UNION ALL
  SELECT 'B', CASE WHEN doc_id % 2 = 0 THEN 'in_dist' ELSE 'transfer' END,
         'task/' || CAST(doc_id AS VARCHAR), doc_id % 3 <> 0 FROM labels)""",
    "step_log": """
step_log AS (
  SELECT 'events' AS run_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS step, value FROM events
  UNION ALL
  SELECT 'short', CAST(i AS BIGINT), i * 1.5 FROM range(10) t(i))""",
    "hourly": """
hourly AS (SELECT run_id, step, avg(value) AS reward FROM step_log GROUP BY run_id, step)""",
    "commits": f"""
commits AS (
  SELECT conv_id AS traj_id, CAST(turn AS INTEGER) AS pos,
         [{", ".join(sql_str(c) for c in _CODES)}][turn % 5 + 1] AS code,
         turn % 5 <> 2 AS syntax_ok
  FROM conversations)""",
    "tasks": """
tasks AS (
  SELECT item_id AS task_id, text AS prompt,
         ['assert f' || CAST(item_id AS VARCHAR) || '(1) == 1',
          'assert f' || CAST(item_id AS VARCHAR) || '(2) == 2'] AS test_list,
         CASE WHEN item_id % 2 = 0 THEN 'mbpp' ELSE 'humaneval' END AS source
  FROM benchmark)""",
    "pairs": """
piv AS (
  SELECT axis, task_id,
         coalesce(bool_or(CASE WHEN label = 'base' THEN passed END), false) AS p_base,
         coalesce(bool_or(CASE WHEN label = 'A' THEN passed END), false) AS p_a,
         coalesce(bool_or(CASE WHEN label = 'B' THEN passed END), false) AS p_b
  FROM eval_results GROUP BY axis, task_id),
pairs AS (
  SELECT *, CASE WHEN p_a AND NOT p_b AND NOT p_base THEN 'only_a'
                 WHEN p_b AND NOT p_a AND NOT p_base THEN 'only_b'
                 WHEN p_a AND p_b AND NOT p_base THEN 'fixed_by_both'
                 WHEN p_base AND NOT p_a AND NOT p_b THEN 'broken_by_both' END AS cls
  FROM piv)""",
    "p1": """
p1 AS (
  SELECT label, axis, avg(CAST(passed AS DOUBLE)) AS pass_at_1, count(*) AS n,
         CAST(sum(CAST(passed AS BIGINT)) AS BIGINT) AS n_passed
  FROM eval_results GROUP BY label, axis)""",
})
VIEWS["tasks_named"] = """
tasks_named AS (
  SELECT task_id, prompt AS text, test_list, """ + ENTRY_STRICT.format(t="test_list") + """ AS fn
  FROM tasks)"""
VIEWS["task_rows"] = """
task_rows AS (
  SELECT *, row_number() OVER (
           ORDER BY ('0x' || substr(md5('0|' || CAST(task_id AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0,
                    task_id) - 1 AS row_idx
  FROM tasks_named)"""


def with_views(body: str, *names: str) -> str:
    order: list[str] = []

    def add(n):
        for d in VIEW_DEPS.get(n, ()):
            add(d)
        if n not in order:
            order.append(n)
    for n in names:
        add(n)
    return "WITH " + ",\n".join(VIEWS[n].strip() for n in order) + "\n" + body


def R(x: str, name: str | None = None) -> str:
    return f"round(CAST({x} AS DOUBLE), 6) + 0.0 AS {name or x}"


ORACLE: dict[str, str] = {}

ORACLE["w01_advantage"] = with_views(f"""
SELECT run_id, step, g, n_turns, {R('final_reward')}, {R('best_reward')}, solved,
       {R('reward')}, {R('advantage')}
FROM adv""", "trajs")


ORACLE["w08_episodes"] = with_views("""
SELECT run_id, step, g, turn, done, NOT done AS active FROM kept""", "trajs")

VIEWS["a16"] = f"""
st AS (
  SELECT run_id, step, avg(reward) AS reward_mean, stddev_samp(reward) AS reward_std,
         sum(CAST(solved AS INTEGER)) / any_value(group_size) AS solve_rate,
         sum(n_turns) / any_value(group_size) AS mean_turns
  FROM adv GROUP BY run_id, step),
lo AS (
  SELECT k.run_id, k.step, avg(-a.advantage) AS pg_loss,
         any_value(CASE WHEN c.variant_fixes THEN
                     CASE WHEN k.step >= c.temp_switch_step THEN c.temp_stage2 ELSE c.temp_stage1 END
                   ELSE c.temperature END) AS temperature
  FROM kept k JOIN adv a USING (run_id, step, g) JOIN run_config c USING (run_id)
  GROUP BY k.run_id, k.step),
a16 AS (
SELECT run_id, step, {R('reward_mean')}, {R('reward_std')}, {R('solve_rate')}, {R('mean_turns')},
       {R('pg_loss')}, {R('temperature')}
FROM st JOIN lo USING (run_id, step))"""
VIEW_DEPS["a16"] = ("trajs",)
ORACLE["a16_step_metrics"] = with_views("SELECT * FROM a16", "a16")

ORACLE["a01_verdicts"] = with_views(f"""
SELECT completion_id, syntax_ok, n_passed, n_total, {R('fraction_passed')}, all_passed,
       {R('(1.0 * fraction_passed) / 1.0', 'reward_default')},
       {R("(0.8 * fraction_passed + 0.1 * CASE WHEN syntax_ok THEN 1.0 ELSE 0.0 END"
          " + 0.1 * CASE WHEN has_fence THEN 0.0 ELSE 1.0 END) / 1.0", 'reward_dense')}
FROM verdicts""", "verdicts")

ORACLE["f05_solved"] = with_views("""
SELECT completion_id, n_total FROM verdicts WHERE all_passed""", "verdicts")

ORACLE["p14_feedback"] = f"""
WITH o AS (SELECT o_orderkey AS completion_id, o_orderstatus <> 'P' AS ok FROM orders),
t AS (SELECT l_orderkey AS completion_id, l_linenumber * 10000000 + l_partkey AS i, 'assert f(' || l_linenumber || ')' AS test,
             l_quantity > 25 AS passed, CASE WHEN l_quantity % 3 <> 0 THEN '  AssertionError: part ' || l_partkey || chr(10) END AS stderr
      FROM lineitem),
e AS (SELECT t.*, ok, CASE WHEN NOT ok THEN 'SyntaxError' WHEN passed THEN ''
                      WHEN coalesce(stderr, '') = '' THEN 'non-zero exit' ELSE stderr END AS error
      FROM t JOIN o USING (completion_id)),
c AS (SELECT completion_id, count(*) AS n, sum(CAST(passed AS BIGINT)) AS p,
             arg_min(test, i) FILTER (WHERE NOT passed) AS ft,
             arg_min(error, i) FILTER (WHERE NOT passed) AS fe FROM e GROUP BY completion_id)
SELECT completion_id, CAST(CASE WHEN ok THEN coalesce(p, 0) ELSE 0 END AS BIGINT) AS n_passed,
       CAST(coalesce(n, 0) AS BIGINT) AS n_total, ft AS first_test, fe AS first_error,
       CASE WHEN NOT ok THEN 'Your code failed to parse (SyntaxError). Return a syntactically valid function.'
            WHEN ft IS NOT NULL THEN 'Your code failed this test:' || chr(10) || ft || chr(10) || 'Error:'
              || chr(10) || CASE WHEN trim(fe) = '' THEN 'assertion failed' ELSE right(regexp_replace(fe, '^\\s+|\\s+$', '', 'g'), 400) END
            ELSE '' END AS feedback
FROM o LEFT JOIN c USING (completion_id)"""

_E = ENTRY_LOOSE.format(t="test_list")
_HE = f"(test_list[1] || chr(10) || chr(10) || 'check(' || {_E} || ')')"
ORACLE["s01_tasks"] = with_views(f"""
SELECT 'mbpp/' || CAST(task_id AS VARCHAR) AS task_id, {_E} AS entry_point,
       {ENTRY_STRICT.format(t="test_list")} AS function_name,
       CAST(len(test_list) AS INTEGER) AS n_tests,
       md5({FIRST_TURN.format(e=_E, p="prompt")}) AS prompt_md5,
       md5({FIRST_TURN.format(e=_E, p="prompt")}) AS user_md5,
       md5('pass' || chr(10) || chr(10) || test_list[1]) AS prog_env_md5,
       md5('' || chr(10) || 'pass' || chr(10) || test_list[1] || chr(10)) AS prog_setup_md5,
       md5('pass' || chr(10) || {_HE} || chr(10) || 'check(' || {_E} || ')' || chr(10)) AS prog_check_md5,
       md5(prompt || chr(10) || 'pass' || chr(10) || chr(10) || {_HE} || chr(10) || chr(10)
           || 'check(' || {_E} || ')') AS prog_prompt_md5,
       'mbpp' AS source
FROM tasks""", "tasks")

_NAMED = "' || chr(10) || chr(10) || 'The function must be named `' || fn || '`.'"
ORACLE["p09_messages"] = with_views(f"""
SELECT task_id, coalesce(fn, '') AS function_name, '' AS test_setup,
       md5({sql_str(RFT_SYS)}) AS rft_system_md5,
       md5(CASE WHEN length(coalesce(fn, '')) > 0
                THEN {STRIP.format(x="text")} || chr(10) || chr(10) || 'The function must be named `' || fn || '`.'
                ELSE {STRIP.format(x="text")} END) AS rft_user_md5,
       md5(CASE WHEN length(coalesce(fn, '')) > 0
                THEN {sql_str(V1_SYS + " The function must be named `")} || fn || '`.'
                ELSE {sql_str(V1_SYS)} END) AS v1_system_md5,
       md5('Solve this Python task:' || chr(10) || chr(10) || text) AS v1_user_md5,
       md5('Complete this function:' || chr(10) || chr(10) || text) AS body_user_md5,
       md5(text || chr(10) || chr(10) || 'The function must be named `' || coalesce(fn, '') || '`.') AS named_user_md5
FROM tasks_named""", "tasks_named")

_FENCE = "'```(?:python)?\\s*\\n?|```'"
_BODY = "'(?s)```(?:python)?\\s*(.*?)```'"
ORACLE["p01_fences"] = (f"""
WITH w AS (
  SELECT doc_id, CASE doc_id % 4
    WHEN 0 THEN 'Here:' || chr(10) || '```python' || chr(10) || text || chr(10) || '```' || chr(10) || 'Done.'
    WHEN 1 THEN '```' || chr(10) || text
    WHEN 2 THEN '```python' || chr(10) || 'a = 1' || chr(10) || '```' || chr(10) || text || chr(10)
                || '```python' || chr(10) || 'b = 2' || chr(10) || '```'
    ELSE chr(10) || chr(9) || text || ' ' || chr(10) END AS c
  FROM documents)
SELECT doc_id,
       md5({STRIP.format(x=f"regexp_replace(c, {_FENCE}, '', 'g')")}) AS stripped_md5,
       md5({STRIP.format(x=f"CASE WHEN regexp_matches(c, {_BODY}) THEN regexp_extract(c, {_BODY}, 1) ELSE c END")}) AS extracted_md5,
       CAST(CASE WHEN contains(c, '```') THEN 0.0 ELSE 1.0 END AS DOUBLE) AS format_reward
FROM w""")

_MEAN = "(CASE WHEN len({a}) = 0 THEN -10.0 ELSE list_sum({a}) / len({a}) END)"
_K3 = "list_transform(range(1, len(lp) + 1), lambda i: exp(ref_lp[i] - lp[i]) - (ref_lp[i] - lp[i]) - 1)"
VIEWS["seq_terms"] = f"""
seq_terms AS (
  SELECT *, exp({_MEAN.format(a="lp")} - {_MEAN.format(a="old_lp")}) AS ratio,
         {_MEAN.format(a="lp")} AS mean_lp, {_MEAN.format(a="old_lp")} AS mean_old_lp,
         list_sum({_K3}) / len(lp) AS kl_all
  FROM logprobs)"""
VIEW_DEPS["seq_terms"] = ("logprobs",)
VIEWS["turn_terms"] = f"""
e AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS v FROM embeddings),
tl AS (
  SELECT k.run_id, k.step, k.g, k.turn, k.event_id, a.advantage, c.*,
         CASE WHEN event_id % 11 = 0 THEN [] ELSE list_transform(e.v, lambda v: -30.0 * abs(v)) END AS lp,
         CASE WHEN event_id % 11 = 0 THEN [] ELSE list_transform(e.v, lambda v: -29.5 * abs(v)) END AS old_lp,
         CASE WHEN event_id % 11 = 0 THEN [] ELSE list_transform(e.v, lambda v: -31.0 * abs(v)) END AS ref_lp,
         ('0x' || substr(md5(k.run_id || '|' || CAST(k.step AS VARCHAR) || '|' || CAST(k.g AS VARCHAR)
           || '|' || CAST(k.turn AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0 AS u
  FROM kept k JOIN adv a USING (run_id, step, g)
  JOIN (SELECT run_id AS rid, variant_fixes AS vf, epsilon_low, epsilon_high, kl_coeff, temperature,
               temp_stage1, temp_stage2, temp_switch_step, mask_prob FROM run_config) c ON c.rid = k.run_id
  JOIN e ON e.vec_id = k.event_id % (SELECT count(*) FROM embeddings)),
tm AS (
  SELECT *, CASE WHEN vf AND event_id % 3 = 0 AND u < mask_prob THEN 0.0 ELSE advantage END AS ma,
         CASE WHEN len(lp) = 0 THEN -10.0 ELSE list_sum(lp) / len(lp) END AS m,
         CASE WHEN len(lp) = 0 THEN -10.0 ELSE list_sum(old_lp) / len(lp) END AS mo,
         CASE WHEN len(lp) = 0 THEN 0.0 ELSE list_sum({_K3}) / len(lp) END AS kl_all
  FROM tl),
turn_terms AS (
  SELECT *, -least(exp(m - mo) * ma, least(greatest(exp(m - mo), 1 - epsilon_low), 1 + epsilon_high) * ma)
              AS surrogate,
         CASE WHEN NOT vf AND kl_coeff > 0 THEN kl_all END AS kl, -m AS entropy
  FROM tm)"""
VIEW_DEPS["turn_terms"] = ("trajs",)
ORACLE["a16_full_step"] = with_views(f"""
, st AS (
  SELECT run_id, step, avg(reward) AS reward_mean, stddev_samp(reward) AS reward_std,
         sum(CAST(solved AS INTEGER)) / any_value(group_size) AS solve_rate,
         sum(n_turns) / any_value(group_size) AS mean_turns
  FROM adv GROUP BY run_id, step),
ob AS (
  SELECT run_id, step, avg(surrogate) AS pg_loss, coalesce(avg(kl), 0.0) AS kl, avg(entropy) AS entropy,
         any_value(kl_coeff) AS kc,
         any_value(CASE WHEN vf THEN CASE WHEN step >= temp_switch_step THEN temp_stage2 ELSE temp_stage1 END
                   ELSE temperature END) AS temperature
  FROM turn_terms GROUP BY run_id, step)
SELECT run_id, step, {R('reward_mean')}, {R('reward_std')}, {R('solve_rate')}, {R('mean_turns')},
       {R('pg_loss')}, {R('kl')}, {R('entropy')}, {R('pg_loss + kc * kl', 'loss')}, {R('temperature')},
       {R('(step % 7) / 7.0', 'grad_norm')}
FROM st JOIN ob USING (run_id, step)""".replace("\n, st AS", ", st AS", 1), "turn_terms")

ORACLE["m07_objective"] = with_views(f"""
SELECT vec_id, {R('mean_lp')}, {R('mean_old_lp')}, {R('ratio')},
       {R('least(greatest(ratio, 1 - 0.2), 1 + 0.2)', 'clip_base')},
       {R('least(greatest(ratio, 1 - 0.2), 1 + 0.5)', 'clip_variant')},
       {R('-least(ratio * adv, least(greatest(ratio, 1 - 0.2), 1 + 0.2) * adv)', 'surr_base')},
       {R('-least(ratio * adv, least(greatest(ratio, 1 - 0.2), 1 + 0.5) * adv)', 'surr_variant')},
       {R('kl_all', 'kl')}, {R('-mean_lp', 'entropy')}
FROM seq_terms""", "seq_terms")

ORACLE["a09_objective"] = with_views(f"""
, t AS (
  SELECT s.*, c.*, CASE WHEN grp % 2 = 0 THEN 'base' ELSE 'variant' END AS rid,
         -least(ratio * adv, least(greatest(ratio, 1 - c.epsilon_low), 1 + c.epsilon_high) * adv) AS surrogate,
         CASE WHEN ref_lp IS NOT NULL AND NOT c.variant_fixes AND c.kl_coeff > 0 THEN kl_all END AS kl,
         -mean_lp AS entropy
  FROM seq_terms s JOIN run_config c ON c.run_id = CASE WHEN s.grp % 2 = 0 THEN 'base' ELSE 'variant' END),
g AS (
  SELECT rid AS run_id, grp, avg(surrogate) AS pg_loss, coalesce(avg(kl), 0.0) AS kl,
         avg(entropy) AS entropy, coalesce(sum(kl), 0.0) / any_value(group_size) AS kl_sum_per_g,
         any_value(kl_coeff) AS kc
  FROM t GROUP BY rid, grp)
SELECT run_id, grp, {R('pg_loss')}, {R('kl')}, {R('entropy')}, {R('kl_sum_per_g')},
       {R('pg_loss + kc * kl', 'loss')}
FROM g""".replace("\n, t AS", ", t AS", 1), "seq_terms", "run_config")

_R = "exp(lp[i] - old_lp[i])"
ORACLE["m08_token_loss"] = with_views(f"""
, t AS (
  SELECT grp, len(lp) AS n_pos,
         list_sum(list_transform(lp, lambda x: -x * adv)) AS s_naive,
         list_sum(list_transform(range(1, len(lp) + 1), lambda i: -{_R} * adv)) AS s_unclipped,
         list_sum(list_transform(range(1, len(lp) + 1), lambda i:
            -least({_R} * adv, least(greatest({_R}, 1 - 0.01), 1 + 0.01) * adv))) AS s_clipped,
         list_sum({_K3}) AS kl_row_sum
  FROM logprobs)
SELECT grp, {R('sum(s_naive) / sum(n_pos)', 'loss_naive')},
       {R('sum(s_unclipped) / sum(n_pos)', 'loss_unclipped')},
       {R('sum(s_clipped) / sum(n_pos)', 'loss_clipped')}, {R('avg(kl_row_sum)', 'kl_penalty')}
FROM t GROUP BY grp""".replace("\n, t AS", ", t AS", 1), "logprobs")

ORACLE["m14_logsoftmax"] = f"""
WITH l AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 10.0) AS lg FROM embeddings),
m AS (SELECT *, list_max(lg) AS mx FROM l)
SELECT vec_id, {R('lg[vec_id % 64 + 1] - (mx + ln(list_sum(list_transform(lg, lambda x: exp(x - mx)))))', 'logp')},
       vec_id - vec_id % 10 AS snapshot
FROM m"""

ORACLE["m01_tokens"] = with_views("""
, t AS (SELECT doc_id, ids, len(ids) AS n, list_position(ids, 'the') AS pos FROM tokens)
SELECT doc_id, CAST(CASE WHEN pos IS NOT NULL THEN pos ELSE n END AS INTEGER) AS cut_len,
       pos IS NULL AND n >= 256 AS truncated, n >= 256 AS trunc_len, n = 256 AS trunc_exact,
       CAST(least(n, 64) AS INTEGER) AS capped_len,
       CASE WHEN n >= 8 THEN list_slice(ids, n - 3, n) = list_slice(ids, n - 7, n - 4) ELSE false END
         AS repetitive
FROM t""".replace("\n, t AS", ", t AS", 1), "tokens")

ORACLE["f03_mask"] = with_views(f"""
, t AS (
  SELECT doc_id, len(ids) >= 256 AS truncated, (doc_id % 5 - 2) / 2.0 AS adv,
         CASE WHEN len(ids) >= 8 THEN list_slice(ids, len(ids) - 3, len(ids))
                                     = list_slice(ids, len(ids) - 7, len(ids) - 4) ELSE false END AS rep,
         ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0 AS u
  FROM tokens),
m AS (SELECT *, truncated AND NOT rep AND u < 0.3 AS masked FROM t)
SELECT doc_id, truncated, masked, {R('CASE WHEN masked THEN 0.0 ELSE adv END', 'masked_advantage')},
       NOT truncated AS kept
FROM m""".replace("\n, t AS", ", t AS", 1), "tokens")

ORACLE["a10_diversity"] = with_views(f"""
, w AS (SELECT grp, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM texts),
tot AS (SELECT grp, CAST(sum(greatest(len(w) - 3, 0)) AS BIGINT) AS n_total FROM w GROUP BY grp),
gr AS (SELECT grp, unnest(list_transform(range(1, len(w) - 2), lambda i: array_to_string(list_slice(w, i, i + 3), ' '))) AS gram
       FROM w WHERE len(w) >= 4),
dis AS (SELECT grp, count(DISTINCT gram) AS n_distinct FROM gr GROUP BY grp)
SELECT grp, n_total, CAST(coalesce(n_distinct, 0) AS BIGINT) AS n_distinct,
       {R('CASE WHEN n_total > 0 THEN coalesce(n_distinct, 0) / n_total ELSE 1.0 END', 'diversity')}
FROM tot LEFT JOIN dis USING (grp)""".replace("\n, w AS", ", w AS", 1), "texts")

_T = ("CAST(contains({c}, 'def ') AS INTEGER), CAST(contains({c}, 'class ') AS INTEGER), "
      "CAST(contains({c}, 'import ') AS INTEGER), CAST(contains({c}, 'return ') AS INTEGER), "
      "CAST(length({c}) > 100 AS INTEGER)")
ORACLE["r13_process"] = with_views(f"""
, p AS (
  SELECT *, last_value(CASE WHEN syntax_ok THEN code END IGNORE NULLS) OVER (
              PARTITION BY traj_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_code,
            pos = max(pos) OVER (PARTITION BY traj_id) AS is_final
  FROM commits),
q AS (
  SELECT *, [{_T.format(c="code")}] AS cur, [{_T.format(c="coalesce(prev_code, '')")}] AS prv,
         prev_code IS NULL OR code <> prev_code AS diff_ok
  FROM p),
r AS (
  SELECT *, CAST(len(list_filter(range(1, 6), lambda i: cur[i] = 1 AND prv[i] = 0)) AS INTEGER) AS n_new,
         cur[1] = 1 AND cur[3] = 1 AND cur[4] = 1 AS req
  FROM q)
SELECT traj_id, pos, syntax_ok, diff_ok, n_new, is_final,
       {R("CASE WHEN NOT syntax_ok THEN -0.1 ELSE 0.1 + CASE WHEN diff_ok THEN 0.2 ELSE 0.0 END"
          " + CASE WHEN n_new > 0 THEN 0.5 ELSE 0.0 END + CASE WHEN is_final AND req THEN 1.0 ELSE 0.0 END END",
          'reward')}
FROM r""".replace("\n, p AS", ", p AS", 1), "commits")

ORACLE["w09_smooth"] = with_views(f"""
, s AS (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY step) AS rn,
         count(*) OVER (PARTITION BY run_id) AS n,
         avg(reward) OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN 14 PRECEDING AND CURRENT ROW) AS sm
  FROM hourly)
SELECT run_id, step, {R('reward')}, {R('sm', 'reward_smooth')} FROM s WHERE n > 15 AND rn >= 15
""".replace("\n, s AS", ", s AS", 1), "hourly")

ORACLE["j07_eval_series"] = with_views(f"""
, e AS (SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS step,
               CAST(event_type = 'purchase' AS DOUBLE) AS hit FROM events),
pts AS (SELECT 'events' AS run_id, step + 1 AS step, avg(hit) AS eval_acc FROM e
        WHERE (step + 1) % 24 = 0 GROUP BY step
        UNION ALL SELECT 'events', CAST(0 AS BIGINT), avg(hit) FROM e),
d AS (SELECT * FROM hourly WHERE run_id = 'events')
SELECT run_id, step, {R('reward')}, {R('eval_acc')} FROM d LEFT JOIN pts USING (run_id, step)
UNION ALL
SELECT run_id, step, NULL AS reward, {R('eval_acc')} FROM pts
WHERE step = 0 AND NOT EXISTS (SELECT 1 FROM d WHERE d.step = 0)
""".replace("\n, e AS", ", e AS", 1), "hourly")

ORACLE["a17_pass1"] = with_views(f"""
, b AS (SELECT axis, pass_at_1 AS bp FROM p1 WHERE label = 'base')
SELECT label, axis, {R('pass_at_1')}, n, n_passed, {R('pass_at_1 - bp', 'delta')},
       CASE WHEN label = 'base' THEN '—' ELSE printf('%+.3f', pass_at_1 - bp) END AS delta_text,
       printf('%d/%d', n_passed, n) AS solved_text
FROM p1 LEFT JOIN b USING (axis)""".replace("\n, b AS", ", b AS", 1), "p1")

ORACLE["a19_two_axis"] = with_views(f"""
SELECT label, {R("avg(CASE WHEN axis = 'in_dist' THEN CAST(passed AS DOUBLE) END)", 'in_dist')},
       {R("avg(CASE WHEN axis = 'transfer' THEN CAST(passed AS DOUBLE) END)", 'transfer')}
FROM eval_results GROUP BY label""", "eval_results")

ORACLE["a21_run_delta"] = with_views(f"""
SELECT a.axis, {R('a.pass_at_1 - b.pass_at_1', 'delta')}
FROM p1 a JOIN p1 b ON a.axis = b.axis AND a.label = 'A' AND b.label = 'B'""", "p1")

ORACLE["u02_classes"] = with_views("""
SELECT axis, task_id, cls FROM pairs WHERE cls IS NOT NULL""", "pairs")

ORACLE["u06_breakdown"] = with_views("""
SELECT CAST(count_if(cls = 'only_a') AS BIGINT) AS n_only_a,
       CAST(count_if(cls = 'only_b') AS BIGINT) AS n_only_b,
       CAST(count_if(cls = 'fixed_by_both') AS BIGINT) AS n_fixed_by_both,
       CAST(count_if(cls = 'broken_by_both') AS BIGINT) AS n_broken_by_both
FROM pairs""", "pairs")

ORACLE["u07_examples"] = with_views("""
, ex AS (SELECT cls, min(task_id) AS task_id FROM pairs WHERE cls IS NOT NULL GROUP BY cls),
d AS (SELECT 'task/' || CAST(doc_id AS VARCHAR) AS task_id, text FROM documents)
SELECT cls, task_id,
       md5(array_to_string(list_transform(string_split(substr(text, 1, 200), chr(10)),
           lambda l: CASE WHEN regexp_matches(l, '\\S') THEN '  ' || l ELSE l END), chr(10))) AS preview_md5,
       a.passed AS a_passed, b.passed AS b_passed,
       md5('  def f(x):' || chr(10) || '      # A' || chr(10) || '      return ' || chr(39) || task_id || chr(39) || chr(10)) AS a_md5,
       md5('  def f(x):' || chr(10) || '      # B' || chr(10) || '      return ' || chr(39) || task_id || chr(39) || chr(10)) AS b_md5
FROM ex JOIN d USING (task_id)
LEFT JOIN (SELECT task_id, passed FROM eval_results WHERE label = 'A') a USING (task_id)
LEFT JOIN (SELECT task_id, passed FROM eval_results WHERE label = 'B') b USING (task_id)
""".replace("\n, ex AS", ", ex AS", 1), "pairs")

ORACLE["a17_passed_sets"] = with_views("""
, t AS (SELECT axis, task_id, row_number() OVER (ORDER BY axis, task_id) - 1 AS task_no
        FROM (SELECT DISTINCT axis, task_id FROM eval_results))
SELECT label, axis, task_id, CAST(task_no AS BIGINT) AS task_no
FROM eval_results JOIN t USING (axis, task_id) WHERE passed
""".replace("\n, t AS", ", t AS", 1), "eval_results")

ORACLE["u02_set_counts"] = with_views("""
SELECT axis, count(*) FILTER (cls = 'only_a') AS n_only_a, count(*) FILTER (cls = 'only_b') AS n_only_b,
       count(*) FILTER (cls = 'fixed_by_both') AS n_fixed_by_both,
       count(*) FILTER (cls = 'broken_by_both') AS n_broken_by_both
FROM pairs GROUP BY axis""", "pairs")

ORACLE["s07_results_lines"] = with_views(f"""
, p AS (SELECT label, axis, {R('avg(CAST(passed AS DOUBLE))', 'pass_at_1')}, count(*) AS n
        FROM eval_results GROUP BY label, axis)
SELECT label, axis, pass_at_1, n, e.task_id
FROM p LEFT JOIN (SELECT label, axis, task_id FROM eval_results WHERE passed) e USING (label, axis)
""".replace("\n, p AS", ", p AS", 1), "eval_results")

ORACLE["j10_membership"] = with_views("""
, a AS (SELECT axis, task_id FROM eval_results WHERE label = 'A' AND passed),
b AS (SELECT axis, task_id FROM eval_results WHERE label = 'B' AND passed)
SELECT axis, task_id, 'both' AS kind FROM a WHERE (axis, task_id) IN (SELECT (axis, task_id) FROM b)
UNION ALL
SELECT axis, task_id, 'a_not_b' FROM a WHERE (axis, task_id) NOT IN (SELECT (axis, task_id) FROM b)
""".replace("\n, a AS", ", a AS", 1), "eval_results")

ORACLE["t02_split"] = with_views("""
SELECT task_id, row_idx, CASE WHEN row_idx < 20 THEN 'train' ELSE 'heldout' END AS split
FROM task_rows WHERE row_idx < 30 AND coalesce(fn, '') <> ''""", "task_rows")

ORACLE["a22_split_sizes"] = with_views("""
SELECT CASE WHEN row_idx < 20 THEN 'train' ELSE 'heldout' END AS split, count(*) AS n
FROM task_rows WHERE row_idx < 30 AND coalesce(fn, '') <> '' GROUP BY 1""", "task_rows")

ORACLE["t03_capped_split"] = with_views("""
, r AS (SELECT task_id, row_number() OVER (ORDER BY task_id) - 1 AS row_idx FROM tasks),
e AS (SELECT least(150, (SELECT count(*) FROM tasks) - 10) AS ed),
s AS (SELECT task_id, row_idx, CASE WHEN row_idx < ed THEN 'train' ELSE 'eval' END AS split
      FROM r, e WHERE row_idx < ed + 10)
SELECT task_id, row_idx, split, row_idx < 5 AS in_first5 FROM s""".replace("\n, r AS", ", r AS", 1), "tasks")

ORACLE["f10_draw"] = with_views(f"""
, tr AS (SELECT 'mbpp/' || CAST(task_id AS VARCHAR) AS task_id, prompt, {_E} AS entry_point,
                row_number() OVER (ORDER BY task_id) - 1 AS row_idx FROM tasks),
st AS (SELECT DISTINCT run_id, step FROM rollouts),
dr AS (SELECT run_id, step, CAST(floor(('0x' || substr(md5('42|' || CAST(step AS VARCHAR)), 1, 8))::BIGINT
                             / 4294967296.0 * (SELECT count(*) FROM tasks)) AS BIGINT) AS row_idx FROM st)
SELECT r.run_id, r.step, r.g, r.turn, tr.task_id,
       md5({FIRST_TURN.format(e="tr.entry_point", p="tr.prompt")}) AS prompt_md5
FROM rollouts r JOIN dr USING (run_id, step) JOIN tr USING (row_idx)""".replace("\n, tr AS", ", tr AS", 1),
                                  "rollouts", "tasks")

_BASE = "'Solve this Python task. The function must be named `f`.' || chr(10) || chr(10) || 'Return x doubled.'"
ORACLE["w07_revision"] = f"""
WITH c AS (SELECT conv_id, turn, role, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nx
           FROM conversations),
a AS (SELECT conv_id, turn AS seq, text AS action, coalesce(nx, '') AS feedback FROM c WHERE role = 'assistant'),
b AS (SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY seq) - 1 AS INTEGER) AS turn,
             lag(action) OVER (PARTITION BY conv_id ORDER BY seq) AS pa,
             lag(feedback) OVER (PARTITION BY conv_id ORDER BY seq) AS pf FROM a),
p AS (SELECT conv_id, turn, CASE WHEN coalesce(length(pf), 0) > 0 THEN {_BASE} || chr(10) || chr(10)
        || 'Your previous attempt was incorrect:' || chr(10) || chr(10) || pa || chr(10) || chr(10) || pf
        || chr(10) || chr(10) || 'Return a corrected, complete function.' ELSE {_BASE} END AS prompt FROM b)
SELECT conv_id, turn, CAST(length(prompt) AS INTEGER) AS prompt_len, md5(prompt) AS prompt_md5 FROM p"""

_INTS = "list_transform({s}, lambda x: CAST(floor(abs(CAST(x AS DOUBLE)) * 10) AS INTEGER))"
ORACLE["r12_sort_rewards"] = f"""
WITH pr AS (SELECT label AS prompt_id, arg_min({_INTS.format(s="embedding[1:len(embedding) // 2]")}, vec_id) AS prompt
            FROM embeddings GROUP BY label),
tr AS (SELECT label AS prompt_id, vec_id, {_INTS.format(s="embedding[len(embedding) // 2 + 1:2 * (len(embedding) // 2)]")} AS response FROM embeddings),
j AS (SELECT tr.*, pr.prompt, list_sort(pr.prompt) AS sp FROM tr JOIN pr USING (prompt_id)),
s AS (SELECT prompt_id, vec_id,
             CAST(len(list_filter(range(1, len(response) + 1), lambda i: response[i] = sp[i])) AS DOUBLE) AS r_dist,
             CAST(len(list_filter(prompt, lambda x: list_contains(response, x)))
                  + len(list_filter(range(1, len(response)), lambda i: response[i] <= response[i + 1])) AS DOUBLE) AS r
      FROM j)
SELECT prompt_id, vec_id, {R('r_dist')}, {R('r', 'r_incl')}, {R('r', 'd_rewards')},
       {R('r - avg(r) OVER w', 'd_centered_rewards')},
       {R('(r - avg(r) OVER w) / (stddev_samp(r) OVER w + 1e-5)', 'd_normalized_rewards')},
       {R('CASE WHEN r = max(r) OVER w THEN r ELSE 0.0 END', 'd_max_rewards')}
FROM s WINDOW w AS (PARTITION BY prompt_id)"""

ORACLE["x07_verify"] = with_views("""
, c AS (SELECT task_id, k.kind FROM tasks, (VALUES ('right'), ('wrong'), ('syntax')) k(kind))
SELECT 'bench/' || CAST(task_id AS VARCHAR) || '/' || kind AS completion_id, kind,
       kind <> 'syntax' AS syntax_ok,
       CAST(CASE WHEN kind = 'right' THEN 2 ELSE 0 END AS BIGINT) AS n_passed,
       CAST(2 AS BIGINT) AS n_total, kind = 'right' AS all_passed,
       CAST(CASE WHEN kind = 'right' THEN 1.0 ELSE 0.0 END AS DOUBLE) AS fraction_passed,
       kind <> 'right' AS has_feedback
FROM c""".replace("\n, c AS", ", c AS", 1), "tasks")

ORACLE["r08_setup_reward"] = with_views("""
, c AS (SELECT task_id, k.kind FROM tasks, (VALUES ('right'), ('wrong'), ('null')) k(kind))
SELECT CAST(task_id AS VARCHAR) || '/' || kind AS completion_id, kind,
       CAST(CASE WHEN kind = 'right' THEN 2 ELSE 0 END AS BIGINT) AS n_passed,
       CAST(2 AS BIGINT) AS n_total,
       CAST(CASE WHEN kind = 'right' THEN 1.0 ELSE 0.0 END AS DOUBLE) AS setup_reward
FROM c""".replace("\n, c AS", ", c AS", 1), "tasks")

ORACLE["a18_eval_accuracy"] = f"""
WITH e AS (SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS step, value > 250 AS passed FROM events)
SELECT 'events' AS run_id, step, {R('avg(CAST(passed AS DOUBLE))', 'pass_at_1')}, count(*) AS n,
       CAST(sum(CAST(passed AS BIGINT)) AS BIGINT) AS n_passed
FROM e WHERE (step + 1) % 24 = 0 GROUP BY step"""

ORACLE["s11_long_metrics"] = with_views("""
SELECT run_id, step, metric, value
FROM a16 UNPIVOT INCLUDE NULLS (value FOR metric IN
  (reward_mean, reward_std, solve_rate, mean_turns, pg_loss, temperature))""", "a16")

_P = "'Solve this Python task. The function must be named `f`.' || chr(10) || chr(10) || 'Return x doubled.'"
_FB = "'Your code failed this test:' || chr(10) || 'assert f(1) == 1'"
ORACLE["x01_episode_twin"] = with_views(f"""
, k AS (SELECT *, 'def f(x):' || chr(10) || '    return ' || CAST(event_id AS VARCHAR) AS action,
               CASE WHEN solved THEN '' ELSE {_FB} END AS feedback FROM kept)
SELECT run_id, step, g, turn, {R('reward')}, solved, done,
       md5(CASE WHEN done THEN ''
                WHEN length(feedback) > 0 THEN {_P} || chr(10) || chr(10)
                  || 'Your previous attempt was incorrect:' || chr(10) || chr(10) || action || chr(10) || chr(10)
                  || feedback || chr(10) || chr(10) || 'Return a corrected, complete function.'
                ELSE {_P} END) AS next_prompt_md5
FROM k""".replace("\n, k AS", ", k AS", 1), "trajs")

ORACLE["x02_group_twin"] = with_views(f"""
, b AS (
  SELECT run_id, step, g, reward, group_size,
         avg(reward) OVER w AS m, stddev_samp(reward) OVER w AS sd, count(*) OVER w AS n
  FROM trajs WINDOW w AS (PARTITION BY run_id, step))
SELECT run_id, step, g, {R('reward')},
       {R('CASE WHEN sd > 1e-6 THEN (reward - m) / (sd + 1e-8) ELSE 0.0 END', 'advantage')},
       n >= group_size AS complete
FROM b""".replace("\n, b AS", ", b AS", 1), "trajs")

ORACLE["x01_stream"] = ORACLE["x01_episode_twin"]

ORACLE["x02_stream"] = with_views(f"""
, f AS (
  SELECT run_id, step, g FROM kept GROUP BY run_id, step, g
  HAVING bool_or(done) AND count(*) = max(turn) + 1),
b AS (
  SELECT run_id, step, g, reward, group_size,
         avg(reward) OVER w AS m, stddev_samp(reward) OVER w AS sd, count(*) OVER w AS n
  FROM trajs JOIN f USING (run_id, step, g) WINDOW w AS (PARTITION BY run_id, step))
SELECT run_id, step, g, {R('reward')},
       {R('CASE WHEN sd > 1e-6 THEN (reward - m) / (sd + 1e-8) ELSE 0.0 END', 'advantage')},
       true AS complete
FROM b WHERE n >= group_size""".replace("\n, f AS", ", f AS", 1), "trajs")

ORACLE["a10_sketch"] = f"""
SELECT grp, n_total, n_distinct AS n_exact, true AS within_bound FROM ({ORACLE["a10_diversity"]})"""

ORACLE["s10_series"] = with_views(f"""
SELECT k.kind, run_id, step, {R('reward')} FROM hourly, (VALUES ('dense'), ('eval')) k(kind)
WHERE k.kind = 'dense' OR (step + 1) % 24 = 0""", "hourly")

ORACLE["s14_text_log"] = """
WITH r AS (
  SELECT CAST(label AS INTEGER) AS epoch, CAST(vec_id % 15 AS INTEGER) AS step,
         CAST(vec_id // 15 AS INTEGER) AS batch,
         [CAST(floor(abs(x) * 100) AS INTEGER) FOR x IN embedding[1:3]] AS p,
         (vec_id % 8) / 8.0 AS lp, (vec_id % 4) / 4.0 AS reward FROM embeddings),
heads AS (SELECT epoch, step, max(reward) AS m FROM r GROUP BY epoch, step),
due AS (SELECT * FROM r WHERE epoch % 10 = 0 AND step % 5 = 0)
SELECT epoch, step, -1 AS batch, -1 AS trial,
       printf('epoch = %d, step = %d, loss = 0.500, reward = %.3f', epoch, step, m) AS line FROM heads
UNION ALL
SELECT epoch, step, batch, -1, '  prompt = [' || array_to_string(p, ', ') || ']' FROM due
UNION ALL
SELECT epoch, step, batch, 0, '  response = [' || array_to_string(list_reverse(p), ', ')
       || printf('], log_probs = [%.3f, -0.500], reward = %.3f, delta = 0.250', lp, reward) FROM due"""
