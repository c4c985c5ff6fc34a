"""Input tables and the reference-shaped views over them.

Each view is one SELECT that reads alike in Spark SQL and in the SQL the results are checked with;
`{name}` stands for a table or another view and ARR for the array constructor.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "v_mcq_list": """
        SELECT p_partkey AS row_id, p_name AS question,
               ARR('A)' || p_brand, 'B)' || p_type, 'C)size ' || CAST(p_size AS string), 'D)' || p_name) AS options,
               chr(CAST(65 + p_partkey % 4 AS int)) AS correct,
               p_type || ' by ' || p_brand AS rationale
        FROM {part}""",
    "v_mcq_label": """
        SELECT p_partkey AS row_id, p_name AS question,
               ARR(p_brand, p_type, 'size ' || CAST(p_size AS string), p_name) AS text,
               CASE WHEN p_partkey % 2 = 0 THEN ARR('A', 'B', 'C', 'D') ELSE ARR('1', '2', '3', '4') END AS label,
               CASE WHEN p_partkey % 2 = 0 THEN chr(CAST(65 + p_partkey % 4 AS int))
                    ELSE chr(CAST(49 + p_partkey % 4 AS int)) END AS answer_key
        FROM {part}""",
    "v_mcq_cols": """
        SELECT p_partkey AS row_id, p_name AS question, p_brand AS first, p_type AS second,
               'size ' || CAST(p_size AS string) AS third, p_name AS fourth,
               CAST(p_partkey % 4 AS int) AS cop,
               CASE WHEN p_partkey % 3 = 0 THEN 'multi' ELSE 'single' END AS choice_type
        FROM {part}""",
    "v_mcq_idx": """
        SELECT p_partkey AS row_id, p_name AS question,
               ARR(p_brand, p_type, 'size ' || CAST(p_size AS string), p_name) AS choices,
               CAST(p_partkey % 4 AS int) AS answer,
               CASE p_partkey % 5 WHEN 0 THEN 'anatomy' WHEN 1 THEN 'college_physics'
                    WHEN 2 THEN 'world_religions' WHEN 3 THEN 'high_school_statistics'
                    ELSE 'marketing' END AS subject,
               CASE p_partkey % 3 WHEN 0 THEN 'auxiliary_train' WHEN 1 THEN 'validation' ELSE 'test' END AS split
        FROM {part}""",
    "v_mixed": """
        SELECT p_partkey AS row_id,
               CASE WHEN p_partkey % 4 = 3 THEN 'open' ELSE 'mcq' END AS question_type,
               p_name AS question_body,
               ARR(p_brand, p_type, 'size ' || CAST(p_size AS string)) AS question_options,
               CASE p_partkey % 5 WHEN 0 THEN p_type WHEN 1 THEN '2'
                    WHEN 2 THEN '[''' || p_type || ''', ''' || p_brand || ''']'
                    WHEN 3 THEN lower(p_type) ELSE 'none of these' END AS question_answer
        FROM {part}""",
    "v_distill": """
        SELECT p_partkey AS row_id, p_name AS prompt,
               CASE p_partkey % 3 WHEN 0 THEN ARR(p_brand, p_type, 'size ' || CAST(p_size AS string))
                    WHEN 1 THEN ARR('') ELSE ARR() END AS options,
               CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE '' END AS answer, p_brand AS brand, p_type AS type
        FROM {part}""",
    "v_candidates": """
        SELECT row_id, prompt, options, answer,
               CASE row_id % 4 WHEN 0 THEN '<think>about ' || brand || '</think>\n ' || type || '</think>'
                    WHEN 1 THEN type WHEN 2 THEN '<think>' || prompt || '</think>' || type END AS answer_a,
               CASE row_id % 4 WHEN 0 THEN 'pre Correct answer: ' || type || '\n\nExplanation: ' || brand || '</s>'
                    WHEN 1 THEN 'no marker ' || type || ' </s>'
                    WHEN 2 THEN 'x answer: y Answer: ' || type ELSE prompt END AS answer_b,
               CASE row_id % 4 WHEN 0 THEN 'q Correct answer: C\nassistant\n\n' || type
                    WHEN 1 THEN 'Answer: ' || prompt || ' answer: ' || type
                    WHEN 2 THEN type ELSE 'system Assistant ' || type || ' Answer: ' || brand END AS answer_c,
               CASE row_id % 8 WHEN 0 THEN 'Ranking: A > B > C' WHEN 1 THEN 'well Ranking: B > C > A. '
                    WHEN 2 THEN 'Ranking: C > A > B..' WHEN 3 THEN 'Ranking: A > A > B'
                    WHEN 4 THEN 'Ranking: A > B' WHEN 5 THEN 'Ranking: A > D > B'
                    WHEN 6 THEN 'Ranking: A > B > C because' END AS ranking
        FROM {v_distill}""",
    "v_responses": """
        SELECT row_id, 'model_a' AS model, answer_a AS response FROM {v_candidates} WHERE answer_a IS NOT NULL
        UNION ALL
        SELECT row_id, 'model_b' AS model, answer_b AS response FROM {v_candidates}
        UNION ALL
        SELECT row_id, 'model_c' AS model, answer_c AS response FROM {v_candidates}""",
    "v_rollouts": """
        SELECT prompt_id, i, final_answer,
               CASE (prompt_id + i) % 6 WHEN 0 THEN final_answer
                    WHEN 1 THEN final_answer || '\nbecause ' || question
                    WHEN 2 THEN lower(final_answer) WHEN 3 THEN '\n' || final_answer
                    WHEN 4 THEN 'E. ' || question
                    ELSE '<think>A\nanswer: B</think>so answer: ' || final_answer || ' ' END AS completion
        FROM (SELECT row_id AS prompt_id, question, UNNEST6 AS i,
                     chr(65 + answer) || '. ' || question AS final_answer
              FROM {v_mcq_idx}) AS r""",
    "v_wiki": """
        SELECT doc_id, source AS page_title, CASE WHEN doc_id % 3 <> 0 THEN lang END AS section_title,
               CASE WHEN doc_id % 5 = 0 THEN '' ELSE source || ' > ' || lang END AS breadcrumb, text
        FROM {documents}""",
    "v_pair": """
        SELECT doc_id, text AS response1, lang || ' ' || source AS response2,
               CAST(doc_id % 7 - 3 AS int) AS overall_preference,
               CASE doc_id % 4 WHEN 0 THEN 'code' WHEN 1 THEN 'stem' WHEN 2 THEN 'general'
                    ELSE 'multilingual' END AS domain
        FROM {documents}""",
    "v_blank": """
        SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN ' \t\n' WHEN 1 THEN ' NaN ' WHEN 2 THEN 'null'
                            WHEN 3 THEN NULL ELSE text END AS text, source
        FROM {documents}""",
    "v_graded": """
        SELECT event_type AS subject, CASE WHEN event_id % 2 = 0 THEN 'zero_shot' ELSE 'few_shot' END AS config,
               CAST(user_id % 5 AS int) AS run, CASE WHEN value > 20 THEN 1 ELSE 0 END AS correct, value AS seconds
        FROM {events}""",
    "v_qa": """
        SELECT doc_id AS query_id, text AS question, lang || ' text of ' || source AS answer, source
        FROM {documents}""",
}

_SPARK = {"ARR()": "CAST(array() AS array<string>)", "ARR(": "array(", "UNNEST6": "explode(sequence(0, 5))"}
_CHECK = {"ARR()": "CAST([] AS VARCHAR[])", "ARR(": "list_value(", "UNNEST6": "unnest([0, 1, 2, 3, 4, 5]::BIGINT[])"}


def _dialect(text: str, words: dict[str, str]) -> str:
    for word, native in words.items():
        text = text.replace(word, native)
    return text


def _references(name: str) -> list[str]:
    return re.findall(r"\{(\w+)\}", VIEWS[name])


class Tables:
    """`t.part` is the table of one data folder, `t.v_wiki` a view over it.
"""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self._folder = spark, folder

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self._folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        """Resolved once per instance: later accesses find the attribute set."""
        if name.startswith("_"):
            raise AttributeError(name)
        if name in VIEWS:
            inputs = {ref: getattr(self, ref) for ref in set(_references(name))}
            table = self.spark.sql(_dialect(VIEWS[name], _SPARK), **inputs)
        else:
            table = self._read(name)
        setattr(self, name, table)
        return table


def check_ctes(names: tuple[str, ...]) -> dict[str, str]:
    """The views a check needs, in order of definition, as common table expressions."""
    ctes: dict[str, str] = {}
    for name in names:
        for ref in _references(name):
            if ref in VIEWS:
                ctes.update(check_ctes((ref,)))
        body = re.sub(r"\{(\w+)\}", r"\1", VIEWS[name])
        ctes[name] = _dialect(body, _CHECK)
    return ctes
