"""Association-rule analytics on Spark DataFrames.

Item records go in, baskets are formed, supports are counted, rules are ranked
and looked up, and the results go to tables.  Every step is a DataFrame plan.
"""

from basketry.operators.baskets import (
    assign_tids,
    basket_items,
    basket_profile,
    explode_baskets,
    sort_items,
    to_baskets,
)
from basketry.operators.bitmaps import itemset_support_bitmap, vertical_bitmap
from basketry.operators.clustering import (
    basket_item_counts,
    cluster_baskets,
    cluster_lines,
    count_vectors,
)
from basketry.operators.lookup import (
    classifier_rules,
    rules_by_antecedent,
    rules_by_consequent,
    rules_from_json,
    rules_to_json,
    with_relative_support,
)
from basketry.operators.recommend import (
    last_transaction,
    match_rules,
    nest_user_rules,
    recommend,
    user_rules,
    user_rules_from_json,
    user_rules_to_json,
)
from basketry.operators.redundancy import drop_redundant
from basketry.operators.ruleindex import match_index, open_rule_index, write_rule_index
from basketry.operators.rules import generate_rules
from basketry.operators.sparse_clustering import cluster_sparse
from basketry.operators.support import (
    item_occurrences,
    item_support,
    itemset_support,
    vertical_index,
)
from basketry.operators.usecases import (
    Attributes,
    attributes_to_items,
    bag_of_attributes,
    best_partner,
    bundles,
    discount_conflicts,
    expand_queries,
)
from basketry.plans.border import IncrementalMiner
from basketry.plans.mining import (
    frequent_itemsets,
    mine,
    pair_support,
    top_k_nr_rules,
    top_k_rules,
)
from basketry.runs import get_rules, log_run, run_status, store_rules
from basketry.session import build_session
from basketry.sources.items import map_fields, read_items
from basketry.sources.rejects import check_fields, check_spmf, read_items_checked
from basketry.sources.sinks import (
    normalize_rules,
    rules_as_documents,
    write_lines,
    write_rules,
    write_rules_jdbc,
    write_rules_parquet,
)
from basketry.sources.text import index_lines, parse_spmf, read_basket_lines, read_spmf

__all__ = [name for name in dir() if not name.startswith("_")]
