"""Fixed values. They must equal the published protocol for results to agree, so they are stated
plainly, in the order in which they are applied (first match wins)."""

# Task label, pattern on the normalised label, item count.
TASKS = [
    ("mmlu_pro", r"^mmlu[\s\-_]*pro", 12032),
    ("mmlu_cot", r"^mmlu\b.*\bcot|^mmlu[_-]cot(?:[_-](?:llama|meta))?\b", 14042),
    ("mmlu", r"^mmlu(?:[_-](?:llama|meta))?\b", 14042),
    ("arc_challenge", r"^arc[\s\-_]*(challenge|c\b)", 1172),
    ("gsm8k", r"^gsm[\s\-_]*8?k", 1319),
    ("hellaswag", r"^hellaswag", 10042),
    ("winogrande", r"^winogrande", 1267),
    ("truthfulqa", r"^truthful", 817),
    ("ifeval", r"^ifeval", 541),
    ("bbh", r"^bbh|^big[\s\-_]*bench", 6511),
    ("math_lvl5", r"^math[\s\-_]*(lvl|lv|vl|v|level)?[\s\-_]*5(?!\d)|^math[\s\-_]*hard", 1324),
    ("gpqa_main_norm", r"^gpqa\b.*acc[\s\-_]*norm", 448),
    ("gpqa_diamond_cot_5shot", r"^gpqa\b.*cot.*diamond|^gpqa\b.*diamond.*cot", 198),
    ("gpqa_main_cot_5shot", r"^gpqa\b.*cot.*main|^gpqa\b.*main.*cot", 448),
    ("gpqa_diamond", r"^gpqa\b.*diamond", 198),
    ("gpqa_main", r"^gpqa", 448),
    ("musr", r"^musr", 756),
    ("humaneval_plus", r"^humaneval\+|^humaneval[\s\-_]*plus", 164),
    ("humaneval", r"^humaneval", 164),
    ("arena_hard", r"^arena[\s\-_]*hard", 500),
]
AMBIGUOUS_TASK = "gpqa_ambiguous_46"
AMBIGUOUS_ITEMS = 448
RECONCILED_TASK = "gpqa_main"
RECONCILE_SPREAD = 5.0
AGGREGATE_PATTERN = r"average|recovery|^score$"

# Feature vocabularies.
TASK_LEVELS = [
    "mmlu", "mmlu_cot", "mmlu_pro", "arc_challenge", "gsm8k", "hellaswag", "winogrande",
    "truthfulqa", "ifeval", "bbh", "math_lvl5", "gpqa_main", "gpqa_main_norm",
    "gpqa_main_cot_5shot", "gpqa_diamond", "gpqa_diamond_cot_5shot", "gpqa_ambiguous_46",
    "musr", "humaneval", "humaneval_plus", "arena_hard",
]
METHOD_LEVELS = ["gptq", "smoothquant", "smoothquant+gptq", "rtn", "awq", "unknown"]

# Treatment name, pattern on the id, weight bits, activation bits, number type.
TREATMENTS = [
    ("nvfp4a16", r"NVFP4A16", 4, 16, "fp"),
    ("nvfp4", r"NVFP4", 4, 4, "fp"),
    ("mxfp4", r"MXFP4", 4, 4, "fp"),
    ("w4a16", r"quantized\.w4a16|[-.]W4A16|INT4", 4, 16, "int"),
    ("w8a8_int", r"quantized\.w8a8|[-.]W8A8(?!-FP)|[-.]INT8", 8, 8, "int"),
    ("w8a16", r"quantized\.w8a16|[-.]W8A16", 8, 16, "int"),
    ("fp8_dynamic", r"FP8[-_]?dynamic", 8, 8, "fp"),
    ("fp8_block", r"FP8[-_]?block", 8, 8, "fp"),
    ("fp8", r"FP8", 8, 8, "fp"),
]
TREATMENT_SUFFIX = (r"[-.](quantized\.w[48]a(?:16|8)|FP8[-_]?dynamic|FP8[-_]?block|FP8|INT8|INT4|"
                    r"NVFP4A16|NVFP4|MXFP4|W4A16|W8A8|W8A16)$")

# Family name and boundary-anchored pattern.
FAMILIES = [
    ("llama-3", r"(?:^|[-_/])(?:Meta-)?Llama-3\.[123](?![\d.])"),
    ("llama-4", r"(?:^|[-_/])Llama-4(?![\d.])"),
    ("qwen2.5", r"(?:^|[-_/])Qwen2\.5(?![\d.])"),
    ("qwen3", r"(?:^|[-_/])Qwen3(?![\d.])"),
    ("mistral", r"(?:^|[-_/])(?:Mistral|Mixtral)(?![\d.])"),
    ("phi-3", r"(?:^|[-_/])Phi-3(?![\d.])"),
    ("gemma-2", r"(?:^|[-_/])gemma-2(?![\d.])"),
    ("granite", r"(?:^|[-_/])granite(?![\d.])"),
]
MOE_SIZE_PATTERN = r"(?:^|[-_])(\d+)x(\d+(?:\.\d+)?)[bB](?![a-zA-Z0-9])"
SIZE_PATTERN = r"(\d+(?:\.\d+)?)\s*[bB](?![a-zA-Z0-9])"
MOE_PATTERN = r"(?i)(\d+x\d+b|a\d+(\.\d+)?b|[-_]\d+e[-_]|mixtral|moe)"

# Method patterns in document text.
METHODS = [
    ("gptq", r"(?i)\bGPTQ\b"),
    ("awq", r"(?i)\bAWQ\b"),
    ("smoothquant", r"(?i)\bSmoothQuant\b"),
    ("rtn", r"(?i)round[-\s]?to[-\s]?nearest|\bRTN\b"),
]

# Table reading.
NUMERIC_CELL = (r"^\**\s*([-+]?\d+(?:\.\d+)?)\s*\**\s*%?\s*\**"
                r"(?:\(\s*[\d\.\s/,+-]+\s*\))?\s*\**$")
TREATED_HINT = (r"(?i)(fp8|w4a16|w8a8|w8a16|int8|int4|nvfp4|mxfp4|quantized|compressed|"
                r"this model|awq|gptq)")
BASELINE_HINT = (r"(?i)(bf16|fp16|fp32|float16|baseline|original|unquantized|dense|"
                 r"full[- ]precision|non[- ]quantized|base model|\bbase\b)")
SECTION_STARTS = ["## Evaluation", "## Accuracy", "### Accuracy", "## Model Evaluation",
                  "### Evaluation"]
SECTION_CUTS = ["## Inference Performance", "### Inference Performance", "Inference Performance",
                "## Performance", "## Deployment"]
MIN_DOCUMENT_BYTES = 200

# Names a user may type, and display labels.
ALIASES = {
    "w4a16": "w4a16", "int4": "w4a16", "gptq": "w4a16", "4bit": "w4a16",
    "w8a8": "w8a8_int", "w8a8_int": "w8a8_int", "int8": "w8a8_int", "smoothquant": "w8a8_int",
    "w8a16": "w8a16", "fp8": "fp8", "fp8_static": "fp8",
    "fp8_dynamic": "fp8_dynamic", "fp8dynamic": "fp8_dynamic",
    "nvfp4": "nvfp4", "fp4": "nvfp4",
}
BANDS = ["<2B", "2-10B", ">10B"]
