"""Declared schemas of the records that the pipeline reads and writes; nothing is inferred."""

EXPLANATION = "target_group string, visual_evidence string, implicit_meaning string, parse_error boolean, raw_output string, error string"
MANIFEST = "image_path string, dataset string, original_label string, ocr_text string, ocr_char_count int, clip_meme_score double, clip_screenshot_score double, clip_best_negative string, clip_threshold_used double, kept string"
UNIFIED = "id string, image_path string, dataset string, text string, hateful int, original_label string, split string"
EXPLAINED = f"id string, image_path string, original_text string, is_hateful boolean, explanation struct<{EXPLANATION.replace(' ', ':').replace(',:', ',')}>"
REWRITE = (
    EXPLAINED.replace("is_hateful boolean, ", "")
    + ", pseudo_rewrite string, sta_score double, bertscore double, original_toxicity double, rewrite_toxicity double, toxicity_drop double"
    + ", passed_stage1_filters boolean, passes_sta boolean, passes_bertscore boolean, passes_toxicity_delta boolean, format_valid boolean, format_reason string, reject_reason string"
)
TRAINING = "id string, image_path string, input_text string, target_text string, original_text string, target_group string, visual_evidence string, implicit_meaning string, condition string, dataset string"
OUTPUT = "idx int, original_text string, rewrite string"
LOG = "step int, loss double, eval_loss double, eval_rougeL double, eval_sta double"
HISTORY = f"global_step int, best_metric double, best_model_checkpoint string, log_history array<struct<{LOG.replace(' ', ':').replace(',:', ',')}>>"
TWEETS = "map<string,struct<labels:array<int>,tweet_text:string>>"
