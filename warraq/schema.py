"""Constants of the evaluation: systems, metrics, classes, input schemas."""

from __future__ import annotations

from pyspark.sql import types as T

# The recognisers and the two reference annotators, in their order.
SYSTEMS = ("gemini_3_1_pro", "claude_sonnet_4_6", "kraken", "google_vision", "kraken_gemma")
REFERENCES = {"muhammad": "gt_muhammad", "hasan": "gt_hasan"}
THIRD_ANNOTATOR = "gt_a3"
REFS = ("muhammad", "hasan", "best")
DISPLAY = {"gemini_3_1_pro": "Gemini 3.1 Pro", "claude_sonnet_4_6": "Claude Sonnet 4.6", "kraken": "Kraken", "google_vision": "Google Vision", "kraken_gemma": "Kraken + Gemma"}
COST_PER_PAGE = {"gemini_3_1_pro": 0.030, "claude_sonnet_4_6": 0.045, "kraken": 0.000, "google_vision": 0.0015, "kraken_gemma": 0.000}

# File name templates, best first; a Turkish keyboard makes a dotted capital of the first letter.
TEMPLATES = {
    "gemini_3_1_pro": ("gmn_{n_variants}.txt",), "claude_sonnet_4_6": ("cld_{n_variants}.txt",), "kraken": ("image_{n}_krkn.txt",), "google_vision": ("image_{n}_G.V.txt",), "kraken_gemma": ("image_{n}_KG.txt",),
    "gt_muhammad": ("image_{n}_GM.txt",), "gt_hasan": ("image_{n}_GH.txt", "İmage_{n}_GH.txt", "Image_{n}_GH.txt"),
}
# Metrics; for the first ones less is better, for the last two more.
LESS_IS_BETTER = ("cer_raw", "cer_normalized", "cer_no_tashkeel", "wer_normalized", "wer_no_tashkeel", "der")
MORE_IS_BETTER = ("chrf_no_tashkeel", "bleu_no_tashkeel")
METRICS = LESS_IS_BETTER + MORE_IS_BETTER

# Strata and samples.
DIFFICULTY_TARGETS = {"C": 1, "H": 4, "D": 3, "S": 2}
OUTLIER_METRICS = ("cer_no_tashkeel", "cer_normalized", "wer_no_tashkeel")
BOX_METRICS = ("cer_no_tashkeel", "cer_normalized", "der")
PRIVATE_REPOSITORY = "Private Furūsiyya corpus (authors)"
OUTLIER_PAGES = ("page_24", "page_33")
SEED = 20260518
MARKER = "--- PREDICTED CONTINUATION ---"
EDIT_CLASSES = ("DIACRITIC_DROP", "DIACRITIC_ADD", "DIACRITIC_WRONG", "HAMZA_FORM", "YA_FORM", "TA_MARBUTA", "LETTER_SUB", "INSERTION", "DELETION", "PUNCT", "OTHER")

CORPUS = T.StructType([
    T.StructField("page_id", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("system", T.StringType()),
    T.StructField("text", T.StringType()), T.StructField("source_path", T.StringType()),
])
DIFFICULTY = T.StructType([T.StructField("page_id", T.StringType()), T.StructField("difficulty", T.StringType())])
PROVENANCE = T.StructType([T.StructField("page_id", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("repository", T.StringType()), T.StructField("manuscript_title", T.StringType())])
