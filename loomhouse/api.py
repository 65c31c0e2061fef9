"""Everything in one place, under the names that row-at-a-time ETL code uses for the same operators."""

from __future__ import annotations

from loomhouse.functions.aggregators import Aggregator, Avg, Count, CountDistinct, Max, Min, Sum
from loomhouse.functions.fifo import FIFODict
from loomhouse.functions.rows import copy, getvalue, getvalueor, project, rename, renamefromto, renametofrom, setdefaults
from loomhouse.functions.scalars import (
    datereader,
    datetimereader,
    getbool,
    getdate,
    getdbfriendlystr,
    getfloat,
    getint,
    getsqlfriendlystr,
    getstr,
    getstrippedstr,
    getstrornullvalue,
    gettimestamp,
    keepasis,
    now,
    today,
    tolower,
    toupper,
    ymdhmsparser,
    ymdparser,
)
from loomhouse.operators.dimension import BulkDimension, CachedBulkDimension, CachedDimension, Dimension, TypeOneSlowlyChangingDimension
from loomhouse.operators.facts import AccumulatingSnapshotFactTable, BatchFactTable, BulkFactTable, DecoupledDimension, DecoupledFactTable, FactTable, SubprocessFactTable
from loomhouse.operators.keys import getsharedsequencefactory
from loomhouse.operators.partitioning import BasePartitioner, DimensionPartitioner, FactTablePartitioner
from loomhouse.operators.scd import SCDimension, SlowlyChangingDimension
from loomhouse.operators.snowflake import SnowflakedDimension
from loomhouse.plans.flow import Flow, createflow, endsplits, shareconnectionwrapper, splitpoint
from loomhouse.plans.steps import (
    AggregatingStep,
    ConditionalStep,
    CopyStep,
    DimensionStep,
    GarbageStep,
    MappingStep,
    PrintStep,
    RenamingFromToStep,
    RenamingStep,
    RenamingToFromStep,
    SCDimensionStep,
    SourceStep,
    Step,
    ValueMappingStep,
    connectsteps,
)
from loomhouse.plans.steps import avgaggregator as AvgAggregator
from loomhouse.plans.steps import maxaggregator as MaxAggregator
from loomhouse.plans.steps import minaggregator as MinAggregator
from loomhouse.plans.steps import sumaggregator as SumAggregator
from loomhouse.plans.store import Error, InterfaceError, JdbcWarehouse, Warehouse, definequote, endload, getdefaulttargetconnection
from loomhouse.sources.readers import backgroundsource as BackgroundSource
from loomhouse.sources.readers import csvsource as CSVSource
from loomhouse.sources.readers import datespan, rowfactory
from loomhouse.sources.readers import dbsource as DatabaseSource
from loomhouse.sources.readers import foreachsource as DynamicForEachSource
from loomhouse.sources.readers import pandassource as PandasSource
from loomhouse.sources.readers import processsource as ProcessSource
from loomhouse.sources.readers import sqlsource as SQLSource
from loomhouse.sources.readers import typedcsvsource as TypedCSVSource
from loomhouse.sources.transforming import crosstab as CrossTabbingSource
from loomhouse.sources.transforming import filteringsource as FilteringSource
from loomhouse.sources.transforming import hashjoin as HashJoiningSource
from loomhouse.sources.transforming import joiningsource as JoiningSource
from loomhouse.sources.transforming import mappingsource as MappingSource
from loomhouse.sources.transforming import mergejoin as MergeJoiningSource
from loomhouse.sources.transforming import roundrobinsource as RoundRobinSource
from loomhouse.sources.transforming import rowtransformation
from loomhouse.sources.transforming import sqltransformingsource as SQLTransformingSource
from loomhouse.sources.transforming import transformingsource as TransformingSource
from loomhouse.sources.transforming import unionsource as UnionSource

ConnectionWrapper = BackgroundConnectionWrapper = Warehouse
JDBCConnectionWrapper = BackgroundJDBCConnectionWrapper = JdbcWarehouse

__all__ = [n for n in dir() if not n.startswith("_") and n != "annotations"]
