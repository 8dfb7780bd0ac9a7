"""The grid of experiments: networks by setting, our detector and the baselines on each, one long table of results.

Experiments run in memory (run, run_grid), or over files: write_data lays the networks of a setting out, run_folder and run_folders
read such folders, and leave results and logs beside them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import DataFrame, SparkSession, functions as F

from kithloom.functions.text import setting_name
from kithloom.operators import evaluation, generators, graph as graphs, measures
from kithloom.operators.membership import last_communities, sizes as sizes_of, split_communities
from kithloom.operators.meta import META, ranking_wide
from kithloom.operators.sampling import anomalous_sizes, bootstrap_sizes
from kithloom.plans.detector import detect
from kithloom.session import cut, keep
from kithloom.sources import readers, writers

#: Widths of the size groups in generated networks, and in real ones with infused communities.
WIDTHS = {"min": 5, "quantile10": 8, "quartile1": 16, "median": 24, "random": 0}
REAL_WIDTHS = {"min": 20, "quantile10": 30, "quartile1": 40, "median": 50, "random": 0}


@dataclass(frozen=True)
class Setting:
    """One cell of the grid."""

    inter_p: float
    m: float
    size_group: str
    network: int
    seed: int = 0


@dataclass(frozen=True)
class Prepared:
    """What an experiment starts from: memberships of both parts, the graph of the test part, and (community, size, is_anomalous)."""

    train: DataFrame
    test: DataFrame
    graph: DataFrame
    communities: DataFrame


def grid(inter_p: Iterable[float], m: Iterable[float], size_groups: Iterable[str], networks: Iterable[int], seed: int = 0) -> list[Setting]:
    """Every combination."""
    return [Setting(a, b, g, n, seed + 1000 * n) for a, b, g, n in product(inter_p, m, size_groups, networks)]


def _parted(net: generators.Network, n_train: int, seed: int) -> Prepared:
    members, known = keep(net.membership, "members"), cut(net.communities)
    split = cut(split_communities(known.select("community", "is_anomalous"), n_train, seed))
    train, test = (keep(members.join(split.where(F.col("split") == s).select("community"), "community", "left_semi"), s) for s in ("train", "test"))
    sub, _ = graphs.induced_subgraph(net.edges, test.select(F.col("vertex").alias("id")))
    return Prepared(train, test, keep(sub, "graph"), known)


def prepare(spark: SparkSession, sizes: DataFrame, setting: Setting, n_normal: int = 110, n_anomalous: int = 10, n_train: int = 20) -> Prepared:
    """A generated network of a setting, with sizes drawn from (community, size)."""
    normal = cut(bootstrap_sizes(sizes, n_normal, setting.seed))
    odd = anomalous_sizes(normal.select(F.col("slot").alias("community"), "size"), n_anomalous, setting.size_group, WIDTHS[setting.size_group], setting.seed + 1)
    named = cut(generators.named_sizes(spark, normal, odd))
    return _parted(generators.generate_network(named, p=setting.m, anomalous_share=setting.inter_p, seed=setting.seed), n_train, setting.seed)


def prepare_infused(graph: DataFrame, members: DataFrame, setting: Setting, n_anomalous: int = 10, n_train: int = 20, k: tuple[int, int] = (1, 1)) -> Prepared:
    """A real network with infused communities of a setting."""
    odd = cut(anomalous_sizes(sizes_of(members), n_anomalous, setting.size_group, REAL_WIDTHS[setting.size_group], setting.seed + 1))
    return _parted(generators.infuse(graph, members, odd, setting.m, setting.inter_p, k, setting.seed), n_train, setting.seed)


def rankings(prepared: Prepared, seed: int = 0, measured: tuple[str, ...] = measures.MEASURES, **detection) -> tuple[DataFrame, DataFrame]:
    """(our, the baselines') rankings of the test communities, in long form."""
    return detect(prepared.train, prepared.test, seed=seed, **detection).ranking, measures.rank_measures(prepared.graph, prepared.test, measured)


def run(spark: SparkSession, sizes: DataFrame, setting: Setting, n_normal: int = 110, n_anomalous: int = 10, n_train: int = 20) -> DataFrame:
    """(p, m, size_group, network, algorithm, community, score, is_anomalous) of one setting: generate, split, detect, rank."""
    return judged(prepare(spark, sizes, setting, n_normal, n_anomalous, n_train), setting)


def judged(prepared: Prepared, setting: Setting) -> DataFrame:
    """The results of one prepared experiment, in the columns of run."""
    ours, base = rankings(prepared, setting.seed)
    scored = ours.unionByName(base).select(F.col("feature").alias("algorithm"), "community", "score")
    marked = evaluation.label_anomalous(scored, prepared.communities.where("is_anomalous").select("community"))
    cell = {"p": F.lit(setting.inter_p), "m": F.lit(setting.m), "size_group": F.lit(setting.size_group), "network": F.lit(setting.network)}
    return marked.select(*(v.alias(k) for k, v in cell.items()), "algorithm", "community", "score", "is_anomalous")


def run_grid(spark: SparkSession, sizes: DataFrame, settings: list[Setting], save_to: str | None = None, **given) -> DataFrame:
    """All settings' results in one table, each kept as it is done; with ``save_to`` also written there, by size group and experiment (K6)."""
    found = reduce(DataFrame.unionByName, [keep(run(spark, sizes, s, **given), "results") for s in settings])
    if save_to is not None:
        writers.write_results(found.withColumnRenamed("network", "enumeration"), save_to)
    return found


def precision(results: DataFrame, baselines_high: bool = True) -> DataFrame:
    """Mean average precision of every setting and algorithm, each judged from its own end."""
    high = evaluation.high_is_anomalous(F.col("algorithm"), baselines_high)
    return evaluation.precision_by_setting(results, ["p", "m", "size_group", "algorithm"], higher_is_anomalous=high)


# --- over files -----------------------------------------------------------------------------------------------------------


def write_data(prepared: Prepared, folder: str, size_group: str, stem: str) -> None:
    """Partition maps and the graph of one network below an experiment's folder, in the names that run_folder looks for (K3, K4, K9)."""
    writers.write_partition_map(prepared.train, f"{folder}/Data/PartitionMaps/{size_group}/{stem}_train_partition.json", lines=True)
    writers.write_partition_map(prepared.test, f"{folder}/Data/PartitionMaps/{size_group}/{stem}_test_partition.json", lines=True)
    writers.write_adjacency(prepared.graph, graphs.nodes_of(prepared.graph), f"{folder}/Data/Networks/{size_group}/{stem}_network.adjlist")


def folder_of(root: str, algorithm: str, setting: Setting, k: tuple[int, int] = (1, 1)) -> str:
    """The folder of a setting's experiments (K9)."""
    return f"{root}/{setting_name(algorithm, setting.inter_p, k, setting.m)}"


def run_folder(
    spark: SparkSession, folder: str, size_groups: Iterable[str] = tuple(WIDTHS), n_anomalous: int = 10, max_experiments: int = 10, measured: tuple[str, ...] = measures.MEASURES,
    anomalous: Callable[[DataFrame], DataFrame] | None = None, lines: bool = True, seed: int = 0, **detection,
) -> int:
    """Runs the first ``max_experiments`` networks of each size group below ``folder`` (O2); returns how many ran.

    Results (OurResults_N.csv, BaselineResults_N.csv) and the log (NetworkLog_N.json) of network N are left in
    ResultsAndLogs/<size group>, each written when that network is done, so a broken run loses one network at most. Anomalous
    communities are the last ``n_anomalous`` of the test part by name, or what ``anomalous`` picks from it.
    """
    done, data = 0, readers.literal(f"{folder}/Data")
    for group in size_groups:
        triples = readers.file_triples(spark, f"{data}/PartitionMaps/{group}", f"{data}/Networks/{group}")
        for t in triples.where(F.col("enumeration") < max_experiments).orderBy("enumeration").toLocalIterator():
            train, test = (keep(readers.read_partition_map(spark, readers.literal(x), lines), "map") for x in (t.train, t.test))
            graph = keep(readers.read_adjacency(spark, readers.literal(t.network))[0], "graph")
            odd = last_communities(test, n_anomalous) if anomalous is None else anomalous(test)
            known = sizes_of(train.unionByName(test)).join(odd.select("community", F.lit(True).alias("is_anomalous")), "community", "left").fillna(False, ["is_anomalous"])
            ours, base = rankings(Prepared(train, test, graph, known), seed, measured, **detection)
            out = f"{folder}/ResultsAndLogs/{group}"
            writers.write_result_csv(ranking_wide(ours, META), f"{out}/OurResults_{t.enumeration}.csv")
            writers.write_result_csv(ranking_wide(base, measured), f"{out}/BaselineResults_{t.enumeration}.csv")
            writers.write_log(f"{out}/NetworkLog_{t.enumeration}.json", t.enumeration, known, train, test)
            done += 1
    return done


def run_folders(spark: SparkSession, root: str, first: int | None = None, last: int | None = None, **given) -> int:
    """run_folder over the experiment folders in ``root``, of which ``first`` and ``last`` cut a slice by name, as of a list (O3)."""
    return sum(run_folder(spark, folder, **given) for folder in readers.list_folders(spark, root)[first:last])
