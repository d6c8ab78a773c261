"""The four training stages from file to final parameters: load, plan, train, save, resume, log."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.config import ModelConfig, TrainConfig, stage_config
from corpusloom.functions import template
from corpusloom.operators import examples, schedule, train
from corpusloom.operators.lm import Params, init_params
from corpusloom.sources import artifacts, jsonl

LATEST = "latest_checkpoint"
#: Name of each stage's final parameters.
FINAL = {"pretrain": "pretrain_final", "sft": "sft_final", "distill": "distill_final", "dpo": "dpo_final"}


def load_examples(spark: SparkSession, stage: str, path: str, max_length: int) -> DataFrame:
    """``line_no`` and the stage's example columns from its strict source, over the byte vocabulary."""
    if stage == "pretrain":
        ids = examples.byte_tokens(template.wrap_text(F.col("text")), max_length)
        made = jsonl.read_pretrain(spark, path).select("line_no", examples.pretrain_example(ids, max_length).alias("e"))
        return made.select("line_no", "e.*")
    chat = lambda text: examples.chat_example(examples.byte_tokens(text, max_length), max_length)
    if stage == "dpo":
        pairs = jsonl.read_preferences(spark, path)
        return pairs.select("line_no", *[chat(template.response_prompt(F.col("prompt"), F.col(side))).alias(side) for side in ("chosen", "rejected")])
    rendered = template.render_chat(template.parity_roles(F.col("messages")))
    return jsonl.read_conversations(spark, path).select("line_no", chat(rendered).alias("e")).select("line_no", "e.*")


def optimizer_state(optimizer: train.AdamW) -> Params:
    moments = {f"{kind}.{n}": v for kind, of in (("m", optimizer.m), ("v", optimizer.v)) for n, v in of.items()}
    return moments | {"t": np.array([optimizer.t], np.float32)}


def load_optimizer(spark: SparkSession, path: str) -> train.AdamW:
    """The optimizer of a checkpoint; a new one where it has none."""
    if not artifacts.exists(spark, f"{path}/optimizer"):
        return train.AdamW()
    state = artifacts.params_dict(spark.read.parquet(f"{path}/optimizer"))
    part = lambda kind: {n[2:]: v for n, v in state.items() if n.startswith(f"{kind}.")}
    return train.AdamW(t=int(state["t"][0]), m=part("m"), v=part("v"))


def run_stage(spark: SparkSession, stage: str, config: ModelConfig, options: TrainConfig | None = None, *, pretrained: str | None = None, reference: str | None = None, metrics: str | None = None, alpha: float = 0.5, temperature: float = 2.0, beta: float = 0.1, stop_after: int | None = None) -> tuple[Params, list[tuple]]:
    """Train one stage; its final parameters and (epoch, step, updates, rate, loss) rows.

    Starts from ``options.resume_from`` (a checkpoint: parameters, optimizer and place), else from ``pretrained``, else from
    seeded parameters; folders that do not exist are passed over. ``reference`` is the frozen teacher of distillation or the
    frozen policy of preferences (then the starting parameters by default). Writes ``latest_checkpoint`` after every batch while the
    updates are a multiple of ``save_step``, ``epoch_N_checkpoint`` after each epoch and at the end the bare parameters; metrics every ``log_step``
    batches where tracking is on. A resumed run repeats the batch that its checkpoint names. ``stop_after`` epochs, the run ends without final parameters.
    """
    options = options or stage_config(stage)
    if options.use_tracker and not metrics:
        raise ValueError("tracking is on, but no metrics table is named")
    params, optimizer, start = init_params(config, options.seed), train.AdamW(), (0, 0, 0)

    def weights(path: str) -> Params:
        return params | artifacts.matching(artifacts.params_dict(artifacts.load_weights(spark, path)), config.shapes())

    if pretrained and artifacts.exists(spark, pretrained):
        params = weights(pretrained)
    begun = params
    if options.resume_from and artifacts.exists(spark, options.resume_from):
        params = weights(options.resume_from)
        if artifacts.exists(spark, f"{options.resume_from}/manifest"):
            optimizer, start = load_optimizer(spark, options.resume_from), artifacts.load_train_state(spark, options.resume_from)[:3]
    frozen = weights(reference) if reference else begun
    if stage == "distill" and not reference:
        raise ValueError("distillation needs a teacher")
    objective = {"distill": lambda: train.Distillation(config, frozen, alpha, temperature), "dpo": lambda: train.Preference(config, frozen, beta)}.get(stage, train.CrossEntropy)()

    data = load_examples(spark, stage, options.data_path, options.max_seq_len)
    plan = schedule.batch_plan(data, "line_no", options.batch_size, options.seed, options.epochs)
    save = lambda name, made, **place: artifacts.save_checkpoint(spark, f"{options.save_dir}/{name}", made, config=vars(config), optimizer=optimizer_state(optimizer), **place)

    def on_step(epoch: int, step: int, updates: int, rate: float, loss: float, made: Params) -> None:
        if step % options.log_step == 0:
            artifacts.log_metrics(spark, metrics, [(stage, epoch, step, n, float(v)) for n, v in (("loss", loss), ("lr", rate), ("global_step", updates))], options.use_tracker)
        if updates > 0 and updates % options.save_step == 0:
            save(LATEST, made, epoch=epoch, step=step, global_step=updates, loss=loss)

    def on_epoch(epoch: int, updates: int, loss: float, made: Params) -> None:
        save(f"epoch_{epoch + 1}_checkpoint", made, epoch=epoch + 1, step=0, global_step=updates, loss=loss)

    made, _, log = train.train(
        data, plan, "line_no", config, params, learning_rate=options.learning_rate, epochs=options.epochs, accumulation=options.accumulation_steps, grad_clip=options.grad_clip,
        optimizer=optimizer, objective=objective, on_step=on_step, on_epoch=on_epoch, start=start, seed=options.seed, last_epoch=stop_after,
    )
    if stop_after is None:
        artifacts.save_checkpoint(spark, f"{options.save_dir}/{FINAL[stage]}", made, raw=True)
    return made, log
