"""Fixed schemas of the file-based relations, as Spark DDL."""

from __future__ import annotations

MANIFEST = (
    "name string, description string, version int, files array<struct<filename:string, id:string, content_details:"
    "struct<download_url:string, view_url:string, sha256_hash:string, content_type:string, size:bigint>>>"
)
PAIRS = (
    "image_path string, mask_path string, filename string, mask_filename string, slice_id string, group_code string, "
    "volume_id string, slice_index int, classes_present string, dominant_class_id int, histology_label string, "
    "coarse_label string, coarse_label_source string"
)
TILES = (
    "image_path string, mask_path string, filename string, slice_id string, volume_id string, group_code string, "
    "coarse_label string, tile_x int, tile_y int, tile_size int, tile_w int, tile_h int, tile_mask_coverage double, "
    "tile_white_frac double"
)
PATCHES = (
    "slice_id string, source_image string, source_mask string, patch_image string, patch_mask string, bbox_y_min int, "
    "bbox_x_min int, bbox_y_max int, bbox_x_max int, bbox_height int, bbox_width int, target_size int, scale_x double, "
    "scale_y double, coarse_label string, group_code string, seed_placeholder int"
)
EDITS = (
    "slice_id string, source_patch string, source_mask string, inpainted_image string, seed bigint, prompt string, "
    "negative_prompt string, num_steps int, guidance_scale double, strength double, base_model string, "
    "lora_weights string, coarse_label string, generated_at_utc timestamp"
)
MERGES = (
    "slice_id string, source_image string, inpainted_patch string, merged_image string, bbox_y_min int, bbox_x_min int, "
    "bbox_y_max int, bbox_x_max int, feather_radius int, original_shape array<int>, patch_size array<int>, "
    "target_size int, seed bigint, prompt string, coarse_label string, merged_at_utc timestamp"
)
QUALITY = (
    "slice_id string, source_image string, merged_image string, passed boolean, rejection_reasons array<string>, "
    "mask_coverage double, non_roi_drift double, seam_quality double, histogram_similarity double, qc_at_utc timestamp"
)
PREDICTIONS = ("image_path string, prompt_index int, expected_label string, pred_label string, confidence double")
SCORED_TASKS = (
    "model_alias string, source_index int, source_key string, source_path string, mask_path string, mask_name string, "
    "tile_x int, tile_y int, tile_w int, tile_h int, source_label string, target_label string, target_index int, "
    "prompt_mode string, prompt string, seed bigint, strength double, mask_dilate_px double, lora_checkpoint string, "
    "generated_path string, pred_label string, confidence double, target_prob double, source_prob double, "
    "target_source_prob_margin double, target_correct boolean, reused_existing boolean"
)
RANKING = (
    "rank int, checkpoint string, combined_reward double, cross_class_margin_score double, "
    "cross_class_target_source_prob_margin_mean double, cross_class_target_top1 double, "
    "same_class_target_prob_mean double, same_class_target_top1 double, summary_json string"
)
HISTORY = (
    "cycle int, start_checkpoint string, train_dataset_path string, train_mask_dir string, cycle_best_checkpoint string, "
    "cycle_best_combined_reward double, cycle_best_cross_class_target_top1 double, cycle_best_same_class_target_top1 double, "
    "cycle_best_cross_class_margin_score double, cycle_best_cross_class_target_prob_margin_mean double, "
    "cycle_best_same_class_target_prob_mean double, global_best_checkpoint string, global_best_combined_reward double, "
    "improved_global_best boolean, reverted_to_global_best boolean, next_start_checkpoint string, "
    "linked_real_anchor_images bigint, real_anchor_images_per_class_cap int, pseudo_rows_kept bigint, pseudo_cross_rows bigint, "
    "pseudo_same_rows bigint, pseudo_dropped_cross_margin bigint, pseudo_dropped_cross_prob bigint, pseudo_dropped_same_prob bigint, "
    "next_curriculum_dataset_path string, next_curriculum_mask_dir string, holdout_combined_reward double, "
    "holdout_cross_class_margin_score double, holdout_cross_class_target_prob_margin_mean double, holdout_cross_class_target_top1 double, "
    "holdout_same_class_target_prob_mean double, holdout_same_class_target_top1 double, holdout_summary_json string, "
    "ranking_json string, ranking_csv string"
)
TRAIN_HISTORY = ("epoch double, train_loss double, val_loss double, val_acc double, val_f1 double")
