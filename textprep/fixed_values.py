"""Texts, tags and limits that a result must contain verbatim.

Everything in this module is data.  It is kept as plain text, in one place, because prompts and
tags are part of the output and must agree character for character with what downstream models
and evaluators expect.
"""

# --- characters removed by a Unicode-aware strip --------------------------------------------
UNICODE_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# --- tags of the public source datasets ------------------------------------------------------
SOURCE_TAGS = {
    "aqua": "deepmind/aqua_rat",
    "arc_challenge": "allenai/ai2_arc_challenge",
    "arc_easy": "allenai/ai2_arc_easy",
    "medmcqa": "openlifescienceai/medmcqa",
    "sciq": "allenai/sciq",
    "mmlu": "cais/mmlu",
    "mmlu_pro": "TIGER-Lab/MMLU-Pro",
    "math_reasoning": "unsloth/OpenMathReasoning",
    "personas": "allenai/tulu-3-sft-mixture",
    "gsm8k": "cais/gsm8k",
    "math_forum": "math-ai/StackMathQA",
    "pool_sciq": "sciq",
    "pool_math": "tulu3-personas-math",
    "distilled": "distilled",
    "code_pairs": "code-preference-pairs",
    "python_pairs": "python-dpo",
    "math_pairs": "math-dpo",
    "steering": "HelpSteer3",
    "reward_bench": "reward-bench",
    "wiki": "https://www.kaggle.com/datasets/conjuring92/wiki-stem-corpus",
}

# --- subject filter of the multi-subject exam set --------------------------------------------
STEM_SUBJECTS = [
    "abstract_algebra",
    "anatomy",
    "college_biology",
    "college_chemistry",
    "college_computer_science",
    "college_mathematics",
    "college_physics",
    "electrical_engineering",
    "elementary_mathematics",
    "high_school_biology",
    "high_school_chemistry",
    "high_school_computer_science",
    "high_school_mathematics",
    "high_school_physics",
    "high_school_statistics",
]

# --- limits and seeds --------------------------------------------------------------------------
SEED = 42
MAX_CHUNK_TOKENS = 512
MAX_CHUNKS_PER_DATASET = 50_000
SFT_MAX_TOKENS = 750
RL_MAX_TOKENS = 128
RAFT_MAX_LENGTH = 1024
GOLDEN_RATIO_IN_CONTEXT = 0.8
SECOND_LABEL_RATIO = 0.9
VALIDATION_FRACTION = 0.1
CALIBRATION_SAMPLES = 512
RETRIEVE_K = 5
SERVE_K = 3
JUDGE_BACKUP_ROWS = 1000
MATH_POOL_ROWS = 5000
PAIR_SUBSET_ROWS = {"code_pairs": 5000, "python_pairs": 7000, "math_pairs": 5000}

# --- cleaning markers --------------------------------------------------------------------------
THINK_END = "</think>"
ANSWER_MARKERS = ["Correct answer:", "Answer:", "answer:"]
END_OF_TEXT = "</s>"
ASSISTANT_MARK = "assistant"
RANKING_MARK = "Ranking:"
RANKING_LABELS = ["A", "B", "C"]
BLANK_WORDS = ["", "nan", "null"]

# --- answer columns, in label order A, B, C ------------------------------------------------------
ANSWER_COLUMNS = ["Qwen/Qwen3-8B", "Mistral-7B-Instruct-v0.2", "Meta-Llama-3-8B-Instruct"]

# --- fallback sentences --------------------------------------------------------------------------
NO_DOCUMENTS = "No documents provided."
NO_RELEVANT_DOCUMENTS = "No relevant documents found."
NO_CLEAR_ANSWER = "I couldn't generate a clear answer for this question."

# --- evaluation prompts --------------------------------------------------------------------------
EVAL_PREAMBLE = (
    "The following are multiple choice questions (with answers) about knowledge and skills in "
    "advanced master-level STEM courses.\n\n"
)
EVAL_PROMPTS = {
    "no_thinking": "The following are multiple choice questions (with answers) about knowledge and "
    "skills in advanced master-level STEM courses.\n\n<|question|>\nAnswer:",
    "thinking": "The following are multiple choice questions (with answers) about knowledge and "
    "skills in advanced master-level STEM courses.\n\n<|question|>\n Thinking and Answer:",
}
FEW_SHOT_EXAMPLES = {
    "no_thinking": [
        (
            "Post moem lividity persists till:\nA. 2-3 days\nB. 18 hours\n"
            "C. Merges with putrefactive changes\nD. 24 hours",
            "D. 24 hours",
        ),
        (
            "A man is walking at a speed of 10 km per hour. After every kilometre, he takes rest for "
            "5 minutes. How much time will he take to cover a distance of 5 kilometres?\n"
            "A. 48 min.\nB. 50 min.\nC. 45 min.\nD. 55 min.\nE. None of these",
            "B. 50 min.",
        ),
        (
            "In which way do sunspots occur?\nA. in fours\nB. in pairs\nC. in threes\nD. by themselves",
            "B. in pairs",
        ),
        ("What is the chemical symbol for gold?\nA. Go\nB. Gd\nC. Au\nD. Ag", "C. Au"),
        (
            "Which planet is known as the Red Planet?\nA. Venus\nB. Mars\nC. Jupiter\nD. Saturn",
            "B. Mars",
        ),
    ],
    "thinking": [
        (
            "What produces almost one-half of the earth's oxygen through photosynthesis?\n"
            "A) prokaryotes\nB) algae\nC) protists\nD) arthropods",
            "<think>While all options perform photosynthesis, algae in the ocean are responsible for "
            "producing about 50% of Earth's oxygen. Prokaryotes include both photosynthetic and "
            "non-photosynthetic organisms. Protists are diverse but not the major oxygen producers. "
            "Arthropods don't perform photosynthesis.</think>\nAnswer: B) algae",
        ),
        (
            "What do you call a type of mixture that has the same composition throughout?\n"
            "A) transfusion\nB) structure\nC) transition\nD) solution",
            "<think>A solution is a homogeneous mixture where the composition is uniform throughout. "
            "Transfusion refers to blood transfer. Structure and transition don't describe mixture "
            "types.</think>\nAnswer: D) solution",
        ),
        (
            "What will spores that eventually germinate develop into?\n"
            "A) new hyphae\nB) hydra\nC) yeast cells\nD) gametes",
            "<think>Spores are reproductive structures of fungi that grow into new hyphae. Hydra are "
            "animals, yeast cells reproduce by budding, and gametes are reproductive cells.</think>\n"
            "Answer: A) new hyphae",
        ),
        (
            "Which of these is NOT a fundamental force of nature?\nA) gravitational force\n"
            "B) electromagnetic force\nC) nuclear force\nD) frictional force",
            "<think>The four fundamental forces are gravitational, electromagnetic, strong nuclear, and "
            "weak nuclear. Frictional force is an emergent phenomenon from electromagnetic "
            "interactions.</think>\nAnswer: D) frictional force",
        ),
        (
            "What is the derivative of ln(x)?\nA) 1/x\nB) x\nC) e^x\nD) ln(x)",
            "<think>The derivative of the natural logarithm function ln(x) is a fundamental result in "
            "calculus. The correct derivative is 1/x. The other options represent different functions "
            "entirely.</think>\nAnswer: A) 1/x",
        ),
    ],
}

# --- retrieval prompts ---------------------------------------------------------------------------
SERVE_PROMPT = (
    "Based on the following context, answer the question. Be concise and accurate.\n\n"
    "Context: {context}\n\nQuestion: {question}\n\nAnswer:"
)
VIEWER_PROMPT = (
    "Based on the following context, answer the question. If the context doesn't contain the answer, "
    "say so.\n\nContext: {context}\n\nQuestion: {question}\n\nAnswer:"
)
BARE_PROMPT = "Question: {question}\nAnswer:"

# --- answer-request prompts: question+options+answer, question+options, question+answer ------------
EXPLAIN_PROMPTS = {
    "qoa": """You are a STEM expert. You are given the following question with options and the correct answer. Please provide a concise explanation for the correct answer.
Begin your answer with the correct answer and afterwards give your explanation. Please do not refer to this message.

Question:
{question}

Options:
{options}

Correct answer:
{answer}""",
    "qo": """You are a STEM expert. You are given the following question with options. Please provide the correct answer and a concise explanation for it.
Begin your answer with the correct answer and afterwards give your explanation. Please do not refer to this message.

Question:
{question}

Options:
{options}""",
    "qa": """You are a STEM expert. You are given the following question and the correct answer. Please provide a concise explanation for the correct answer.
Begin your answer with the correct answer and afterwards give your explanation. Please do not refer to this message.

Question:
{question}

Correct answer:
{answer}""",
}
EXACT_FORMAT_PROMPTS = {
    "qoa": """You are a STEM expert. You are given the following question with options and the correct answer. Please provide a concise, short explanation for the correct answer.
Provide your answer in this exact format: Answer: <correct answer> \n\nExplanation: <short explanation>
Please do not refer to this message.

Question:
{question}

Options:
{options}

Correct answer:
{answer}""",
    "qo": """You are a STEM expert. You are given the following question with options. Please provide the correct answer and a concise, short explanation for it.
Provide your answer in this exact format: Answer: <correct answer> \n\nExplanation: <short explanation>
Please do not refer to this message.

Question:
{question}

Options:
{options}""",
    "qa": """You are a STEM expert. You are given the following question and the correct answer. Please provide a concise, short explanation for the correct answer.
Provide your answer in this exact format: Answer: <correct answer> \n\nExplanation: <short explanation>
Please do not refer to this message.

Question:
{question}

Correct answer:
{answer}""",
}

# --- judging prompts ---------------------------------------------------------------------------------
JUDGE_PROMPTS = {
    "qoa": """You are an expert STEM educator and evaluator. Your job is to rank three student‐style answers to a STEM question. You must judge primarily on whether the answer is correct. If two or more are equally correct, break the tie by clarity of explanation—answer that is easier to follow gets the higher rank.

Below is the question with answer options and the correct answer, followed by three candidate answers labeled A, B, and C.  

Question:
{question}

Options:
{options}

Correct answer:
{answer}

---  
Answer A:
{answer_a}

Answer B:
{answer_b}

Answer C:
{answer_c}

---

Step 1: For each answer (A, B, and C), judge whether it is mathematically or factually correct.  
Step 2: If more than one is correct, compare clarity and completeness of explanation.  
Step 3: At the end, output a single line in this exact format with no extra text before or after: Ranking: <best_label> > <middle_label> > <worst_label>. For example: Ranking: B > A > C. Do not output any other commentary or text.""",
    "qo": """You are an expert STEM educator and evaluator. Your job is to rank three student‐style answers to a STEM question. You must judge primarily on whether the answer is correct. If two or more are equally correct, break the tie by clarity of explanation—answer that is easier to follow gets the higher rank.

Below is the question with answer options, followed by three candidate answers labeled A, B, and C.  

Question:
{question}

Options:
{options}

---  
Answer A:
{answer_a}

Answer B:
{answer_b}

Answer C:
{answer_c}

---

Step 1: For each answer (A, B, and C), judge whether it is mathematically or factually correct.  
Step 2: If more than one is correct, compare clarity and completeness of explanation.  
Step 3: At the end, output a single line in this exact format with no extra text before or after: Ranking: <best_label> > <middle_label> > <worst_label>. For example: Ranking: B > A > C. Do not output any other commentary or text.""",
    "qa": """You are an expert STEM educator and evaluator. Your job is to rank three student‐style answers to a STEM question. You must judge primarily on whether the answer is correct. If two or more are equally correct, break the tie by clarity of explanation—answer that is easier to follow gets the higher rank.

Below is the question with the correct answer, followed by three candidate answers labeled A, B, and C.  

Question:
{question}

Correct answer:
{answer}

---  
Answer A:
{answer_a}

Answer B:
{answer_b}

Answer C:
{answer_c}

---

Step 1: For each answer (A, B, and C), judge whether it is mathematically or factually correct.  
Step 2: If more than one is correct, compare clarity and completeness of explanation.  
Step 3: At the end, output a single line in this exact format with no extra text before or after: Ranking: <best_label> > <middle_label> > <worst_label>. For example: Ranking: B > A > C. Do not output any other commentary or text.""",
}
