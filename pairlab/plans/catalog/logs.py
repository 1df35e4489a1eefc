"""Metric-log queries: running best, checkpoints, early stop, throughput."""

from __future__ import annotations

from pairlab.operators import training_log as L
from pairlab.plans import fixtures as FX
from pairlab.plans.catalog.base import register, rsql


@register("running_best", rsql("""
select run, metric, step, value, coalesce(prev, 0.0) as previous_best, value > coalesce(prev, 0.0) as improved,
       greatest(coalesce(prev, 0.0), value) as best
from (select *, max(value) over (partition by run, metric order by step
                                 rows between unbounded preceding and 1 preceding) as prev from metric_log) x""",
                               "value,previous_best,best", ("metric_log",)))
def running_best(t):
    return L.running_best(FX.metric_log(t))


@register("best_checkpoint", rsql("""
select run, metric, arg_min(step, [value, step]) as best_step, min(value) as best_value
from metric_log group by run, metric""", "best_value", ("metric_log",)))
def best_checkpoint(t):
    return L.best_checkpoint(FX.metric_log(t), mode="min")


@register("early_stop_step", rsql("""
with recursive s(run, metric, step, best, bad, stop) as (
  select run, metric, step, value, 0, cast(null as bigint) from metric_log where step = 1
  union all
  select s.run, s.metric, m.step,
         case when s.stop is null and s.best - m.value > 0.01 then m.value else s.best end,
         case when s.stop is not null then s.bad when s.best - m.value > 0.01 then 0 else s.bad + 1 end,
         coalesce(s.stop, case when s.best - m.value > 0.01 then null
                               when s.bad + 1 >= 3 then m.step end)
  from s join metric_log m on m.run = s.run and m.metric = s.metric and m.step = s.step + 1)
select s.run, s.metric, s.stop as stop_step, s.best as best_value, n.n_evals
from s join (select run, metric, max(step) as last, count(*) as n_evals from metric_log group by all) n
  on n.run = s.run and n.metric = s.metric and s.step = n.last""", "best_value", ("metric_log",)))
def early_stop_step(t):
    """Sequential fold per run (the oracle is a recursive CTE)."""
    return L.early_stop_step(FX.metric_log(t), patience=3, threshold=0.01, mode="min")


@register("generation_throughput", rsql("""
select language, count(*) as batches, cast(sum(n_rows) as bigint) as total_rows, sum(seconds) as total_seconds,
       avg(case when seconds = 0 then null else n_rows / seconds end) as mean_batch_rows_per_sec,
       case when sum(seconds) = 0 then null else sum(n_rows) / sum(seconds) end as rows_per_sec
from generation_log group by language""", "total_seconds,mean_batch_rows_per_sec,rows_per_sec",
        ("generation_log",)))
def generation_throughput(t):
    return L.generation_throughput(FX.generation_log(t))


@register("example_count", rsql("""
select run, metric, step, cast(step * 32 as bigint) as examples_seen from metric_log""", "", ("metric_log",)))
def example_count(t):
    return L.example_count(FX.metric_log(t), batch_size=8, accumulation=4).select("run", "metric", "step",
                                                                                   "examples_seen")
