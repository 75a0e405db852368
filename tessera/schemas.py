"""Explicit schemas of the records that stages exchange; every field is nullable."""

from __future__ import annotations

import re


def struct(fields: str) -> str:
    """A field list "a string, b array<...>" as a struct type."""
    parts = re.findall(r"(\w+) ((?:[^,<>]|<(?:[^<>]|<(?:[^<>]|<[^<>]*>)*>)*>)+)(?:, |$)", fields)
    return "struct<" + ",".join(f"{name}:{kind}" for name, kind in parts) + ">"


TURN = "struct<question:string,answer:string>"
IMAGE = "struct<buffer:string,image_id:string>"
METRIC = "struct<general_metric_description:string,specific_metric_description:string>"
MERGED_METRIC = "struct<general:string,specific:array<string>>"

RAW_SAMPLE = f"dialogue array<{TURN}>, image_buffer_list array<{IMAGE}>, image_id_list array<string>, task_type string, source string"
FLAT_SAMPLE = "question string, answer string, image string"
CLUSTER_FILE = f"metadata struct<total_samples:bigint,n_clusters:bigint,algorithm:string>, clusters array<struct<cluster_id:bigint,size:bigint,percentage:double,samples:array<struct<sample_id:bigint,cluster_id:bigint,data:struct<dialogue:array<{TURN}>,image_buffer_list:array<{IMAGE}>,image_id_list:array<string>,task_type:string,source:string>>>>>"
DATA_SAMPLE = f"sample_id string, image_base64 array<string>, dialogue array<{TURN}>, metadata struct<cluster_id:bigint,source:string,task_type:string,image_id_list:array<string>>"
CLUSTER_SAMPLES = f"cluster_id bigint, cluster_size bigint, sample_size bigint, sampling_strategy string, samples array<{struct(DATA_SAMPLE)}>"
EVALUATION = (
    "model_name string, model_capability string, sample_id string, correctness_score double, correctness_confidence double, correctness_rationale string, "
    "training_quality_score double, training_quality_confidence double, training_quality_rationale string, "
    f"recommended_metrics array<{METRIC}>, overall_assessment string, timestamp string, information_recap string"
)
EVALUATION_TRIPLE = "sample_id string, " + ", ".join(f"{c} {struct(EVALUATION)}" for c in ("weak", "normal", "sota"))
SAMPLE_METRICS = f"sample_id string, merged_metrics array<{MERGED_METRIC}>, difficulty_score double, confidence_score double, correctness_std double, training_std double"
AGENT_CATALOG = "agents array<struct<name:string,specialty:array<string>,suggested_models:array<string>,prompt_scaffold:string,prompt:string>>"
TASK = "sample_id string, agent string, prompt string"
TASK_RESULT = "sample_id string, agent string, text string, raw string, usage string, error string"
SELECTION_INPUT = "report string, agent_list array<string>, filtered_datasets array<struct<data_ids:array<bigint>,metadata:struct<filter_reason:string,sample_count:bigint>>>"
SELECTION_ROW = "report string, ground_truth_agents array<string>, ground_truth_filtered_data array<bigint>"
BENCHMARK_TASK = "task_id string, question string, images array<string>, ground_truth string, metadata map<string,string>"
BENCHMARK_CATALOG = "benchmarks array<struct<name:string,source:string,hf_id:string,config:string,available_splits:array<string>,default_split:string,native_taxonomy_fields:array<string>,note:string>>"
EPOCH_HISTORY = "epoch bigint, timestamp string, train map<string,double>, val map<string,double>"
MODEL_VERSION = "version string, model_path string, config_path string, created_at string, training_epochs bigint, final_reward double, description string, metadata map<string,string>"
