"""Schemas of the experiment's tables, as DDL text."""

CORPUS = ("utterance string, intent string, word_count int, language string, framework string, error_type string")
SELECTED_TASKS = (
    "utterance string, intent string, word_count int, language string, framework string, error_type string, "
    "cluster int, task_id string")
RAW_TASKS = (
    "task_id string, intent string, raw_utterance string, source string, cluster int, "
    "entities_in_source struct<language:string,framework:string,error_type:string>, sub_intents array<string>")
GOLD = (
    "task_id string, functional_output_description string, intent_preservation_reference string, "
    "expected_tools array<string>, minimum_required_tools array<string>, "
    "alternative_tool_sequences array<array<string>>, "
    "entities struct<error_type:string,component:string,language:string,framework:string>, "
    "has_unit_test boolean, unit_test_path string")
TASKS_MASTER = (
    "task_id string, intent string, raw_utterance string, source string, "
    "gold_standard struct<functional_output_description:string,intent_preservation_reference:string,"
    "intent_preservation_embedding:array<float>,expected_tools:array<string>,minimum_required_tools:array<string>,"
    "alternative_tool_sequences:array<array<string>>,"
    "entities:struct<error_type:string,component:string,language:string,framework:string>>, "
    "has_unit_test boolean, unit_test_path string, sub_intents array<string>")
CONDITIONS = (
    "task_id string, intent string, condition_a string, condition_b string, "
    "condition_c struct<raw_utterance:string,normalized:string,intent:string,confidence_score:double,"
    "entities:struct<error_type:string,component:string,language:string,framework:string>,"
    "_parse_error:string,_api_error:string>")
RESULTS = (
    "run_id string, task_id string, intent string, condition string, model string, timestamp timestamp, "
    "prompt string, response string, input_tokens bigint, output_tokens bigint, total_tokens bigint, "
    "tool_calls_json string, tool_sequence string, total_tool_calls bigint, execution_time_sec double, error string")
SCORES = (
    "run_id string, intent_preservation double, tool_precision double, tool_recall double, tool_f1 double, "
    "total_tool_calls bigint, redundant_calls bigint, first_call_correct bigint, min_req_met bigint, "
    "hallucination_score bigint, intent_fidelity_score bigint, functional_correct boolean")
RULES = ("task_id string, clause int, ignore_case boolean, any_of array<string>")
