"""Command line: scan folders, files, clones, their histories, lists of them, and what a hosting service lists."""

from __future__ import annotations

import argparse
import json
import os
import shutil
import sys
import tempfile
import time
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from . import __version__
from .operators import accepted, registry, state
from .operators.detect import verifiers
from .plans import scan
from .sources import archives, files, git, hosting, joblog, sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("leakloom", description=__doc__)
    add = p.add_argument
    add("--version", action="version", version=__version__)
    add("--target", action="append", default=[], help="folder, file, local clone or address of a repository; may repeat")
    add("--repo-list")
    add("--orgs", default="", help="organisations whose repositories are scanned, by commas")
    add("--enterprise")
    add("--accessible", action="store_true", help="all repositories that the token reaches")
    add("--token", default=os.environ.get("GITHUB_TOKEN", ""))
    add("--app-id", default=os.environ.get("GITHUB_APP_ID", ""))
    add("--app-key", default=os.environ.get("GITHUB_APP_PRIVATE_KEY", ""), help="file with the application's private key")
    add("--installation", default=os.environ.get("GITHUB_INSTALLATION_ID", ""))
    add("--api", default="https://api.github.com")
    add("--clones", help="folder for clones that the executors reach; default: a temporary one")
    add("--repo-concurrency", type=int, default=1)
    add("--history", action="store_true", help="also scan the history of clones")
    add("--include", default="")
    add("--exclude", default="")
    add("--max-file-size", type=int, default=files.MAX_FILE)
    add("--archives", action="store_true")
    add("--archive-depth", type=int, default=2)
    add("--archive-max-entries", type=int, default=10_000)
    add("--archive-max-bytes", type=int, default=250 << 20)
    add("--archive-max-entry", type=int, default=0, help="bytes of an entry; default: those of a file")
    add("--detectors", help="JSON file of custom detectors")
    add("--registry", help="table of detector specifications")
    add("--verify", action="store_true", help="ask the providers whether secrets are live")
    add("--verify-store", help="folder where live secrets are kept under a hash, so that later runs needn't ask again")
    add("--baseline")
    add("--write-baseline")
    add("--baseline-index", help="folder of an index of accepted fingerprints, for baselines of any size")
    add("--write-baseline-index", help="new folder for an index of the findings' fingerprints")
    add("--format", default="human", choices=sinks.FORMATS)
    add("--output", nargs="?", const="", help="file of the findings; without a name, findings with the format's ending")
    add("--flush-findings", type=int, default=25, help="findings after which a JSON lines output is made durable")
    add("--resume-output", default="append", choices=("append", "overwrite", "new"))
    add("--summary", help="file for the summary")
    add("--summary-only", action="store_true", help="discover, write the summary, and scan nothing")
    add("--raw-secrets", action="store_true")
    add("--fail-on-findings", action="store_true")
    add("--quiet", action="store_true")
    add("--no-color", action="store_true")
    add("--state", help="job state file; kept where this, a job id or a resumed job is given")
    add("--job-log", help="folder where the states of jobs are kept as a log, which several drivers may write at a time")
    add("--job-id")
    add("--resume", help="id of a job: scan what isn't completed")
    add("--retry-failed", help="id of a job: scan what failed")
    add("--list-detectors", action="store_true")
    add("--parity", action="store_true")
    return p


def split(text: str) -> list[str]:
    return [x.strip() for x in text.split(",") if x.strip()]


def parity(spark: SparkSession, detectors: tuple[registry.Detector, ...]) -> dict:
    own, frame = registry.mappings(spark, detectors), registry.frame(spark, detectors)
    return {
        "statuses": [r.asDict() for r in state.parity_counts(own).orderBy("status").collect()],
        "outside_catalog": sorted(r[0] for r in state.parity_outside(registry.catalog(spark), own).select("catalog_id").distinct().collect()),
        "duplicates": [r.asDict() for r in state.parity_duplicates(own).orderBy("catalog_id").collect()],
        "untracked_detectors": state.parity_untracked(frame, own).count(),
    }


class Console:
    """Progress on the error stream: time, level and text; findings by severity, redacted unless raw values are asked for."""

    COLOURS = {"critical": "35", "high": "31", "medium": "33"}

    def __init__(self, quiet: bool = False, colour: bool = True, stream=None) -> None:
        self.quiet, self.stream = quiet, stream or sys.stderr
        self.colour = colour and hasattr(self.stream, "isatty") and self.stream.isatty()

    def say(self, text: str, level: str = "info") -> None:
        if not self.quiet or level == "error":
            print(f"{time.strftime('%H:%M:%S')} {level} {text}", file=self.stream)

    def severity(self, name: str) -> str:
        code = self.COLOURS.get(name.lower())
        return f"\x1b[{code}m{name}\x1b[0m" if self.colour and code else name

    def findings(self, found: DataFrame, raw: bool = False) -> None:
        if not self.quiet:
            for r in found.toLocalIterator():
                print(f"  [{self.severity(r['severity'])}] {r['name']} {r['file']}:{r['line']} {r['secret'] if raw else r['redacted']}", file=self.stream)


def discover(args: argparse.Namespace, spark: SparkSession, transport=hosting.urllib_transport) -> tuple[list[str], dict, dict[str, str]]:
    """(targets, discovery summary, token by owner in lower case) of what the hosting service lists."""
    orgs = split(args.orgs)
    if not (orgs or args.enterprise or args.accessible):
        return [], {}, {}
    key = ""
    if args.app_key:
        with open(args.app_key, encoding="utf-8") as f:
            key = f.read()
    found = hosting.clients(transport, args.api, args.token, args.app_id, key, args.installation, orgs, every=bool(args.enterprise or args.accessible))
    if not found:
        raise SystemExit("discovery needs a token, or an application's id and key")
    rows, tokens, installations = [], {}, []
    for account, client in found:
        if orgs:
            own = [r for o in orgs if not account or o.lower() == account.lower() for r in client.organisation(o)]
        elif args.enterprise:
            own = client.organisation(account) if account else client.enterprise_repositories(args.enterprise)
        else:
            own = client.accessible()
        rows += own
        installations.append({"account": account, "repositories": len(own)})
        tokens |= {(r.get("full_name") or "").split("/")[0].lower(): client.token for r in own}
    repositories = state.last_by_name(hosting.repositories(spark, rows), "idx").collect()
    owners: dict[str, int] = {}
    for r in repositories:
        owners[r["full_name"].split("/")[0]] = owners.get(r["full_name"].split("/")[0], 0) + 1
    summary = {"repositories": len(repositories), "installations": installations, "orgs": [{"name": k, "repositories": v, "findings": 0} for k, v in sorted(owners.items())]}
    return [r["clone_url"] or f"https://github.com/{r['full_name']}" for r in repositories], summary, tokens


def main(argv: list[str] | None = None, spark: SparkSession | None = None, transport=hosting.urllib_transport, clone=git.clone) -> int:
    args = parser().parse_args(argv)
    clones = args.clones or tempfile.mkdtemp(prefix="leakloom-clones-")
    held: list[DataFrame] = []
    try:
        return run(args, clones, spark, transport, clone, held)
    finally:  # not before: what is computed again after a loss reads the clones again
        for found in held:  # a later run in this session must not be given what a folder held now
            found.unpersist()
        if not args.clones:
            shutil.rmtree(clones, ignore_errors=True)


def run(args: argparse.Namespace, clones: str, spark: SparkSession | None, transport, clone, held: list[DataFrame]) -> int:
    if args.resume and args.retry_failed:
        raise SystemExit("--resume and --retry-failed exclude each other")
    if args.repo_list and (args.orgs or args.enterprise or args.accessible):
        raise SystemExit("--repo-list and discovery exclude each other")
    if args.output == "":
        args.output = sinks.default_path(args.format)
    if args.output and args.resume_output == "append" and (args.resume or args.retry_failed) and args.format != "jsonl":
        raise SystemExit("only --format jsonl can be appended to; choose --resume-output overwrite or new")
    detectors = registry.load(args.registry) + (registry.load_custom(args.detectors) if args.detectors else ())
    if args.list_detectors:
        print(json.dumps([d.info() for d in detectors], indent=2))
        return 0
    spark = spark or SparkSession.builder.appName("leakloom").getOrCreate()
    if args.parity:
        print(json.dumps(parity(spark, detectors), indent=2))
        return 0
    console = Console(args.quiet, not args.no_color)
    found_targets, discovery, tokens = discover(args, spark, transport)
    listed = [r[0] for r in files.read_targets(spark, args.repo_list).toLocalIterator()] if args.repo_list else []
    targets = list(dict.fromkeys([*args.target, *listed, *found_targets])) or ["."]
    if not args.clones and any(map(hosting.is_remote, targets)) and not spark.sparkContext.master.startswith("local"):
        raise SystemExit("on a cluster --clones must name a folder that the driver and all executors share")
    if args.summary_only:
        text = json.dumps(sinks.summary({}, discovery, known=targets), indent=2)
        sinks.write_private(args.summary, text + "\n") if args.summary else print(text)
        return 0
    job = args.resume or args.retry_failed or args.job_id or sinks.job_id(sinks.job_scope(targets[0], args.repo_list or "", split(args.orgs), args.enterprise or "", args.accessible), time.time())
    keeps = bool(args.state or not args.job_log and (args.job_id or args.resume or args.retry_failed))
    state_path = args.state or f".leakloom/{job}.json"
    jobs = {}
    if args.resume or args.retry_failed:
        jobs = joblog.read(spark, args.job_log, job) if args.job_log else sinks.read_job(state_path, job)
    every_target = list(targets)
    if args.retry_failed:
        targets = [t for t in targets if jobs.get(t, {}).get("status") == "failed"]
    elif args.resume:
        targets = [t for t in targets if jobs.get(t, {}).get("status") != "completed"]
    limits = archives.Limits(args.archive_depth, args.archive_max_entries, args.archive_max_bytes, args.archive_max_entry or args.max_file_size) if args.archives else None
    if args.baseline and args.baseline_index:
        raise SystemExit("--baseline and --baseline-index exclude each other")
    baseline = accepted.load(args.baseline_index) if args.baseline_index else sinks.read_baseline(spark, args.baseline) if args.baseline else None
    options = {"include": split(args.include), "exclude": split(args.exclude), "max_file": args.max_file_size}
    writer, written = None, ""
    if args.output:
        written, mode = sinks.resume_path(args.output, args.resume_output if args.resume or args.retry_failed else "overwrite", kind=args.format)
        if args.format == "jsonl":
            writer = sinks.LineWriter(written, args.flush_findings, args.raw_secrets, mode)

    logged: dict[str, tuple] = {}

    def save() -> None:
        if args.job_log:
            changed = {t: (x["status"], x.get("attempts", 0)) for t, x in jobs.items() if t in targets and (x["status"], x.get("attempts", 0)) != logged.get(t)}
            joblog.append(args.job_log, job, [(t, s, jobs[t].get("error"), None) for t, (s, _) in changed.items()])
            logged.update(changed)
        if keeps:
            sinks.write_job(state_path, job, jobs)

    def scanned(target: str, place: str) -> DataFrame:
        found = scan.of_folder(spark, place, detectors, limits=limits, **options)
        if args.history and os.path.isdir(os.path.join(place, ".git")):
            found = found.unionByName(scan.of_history(spark, place, detectors, options["include"], options["exclude"], limits, args.max_file_size)).dropDuplicates(["fingerprint"])
        held.append(found.cache())
        return found

    def one(target: str) -> tuple[str, DataFrame | None, str, int]:
        """(target, findings, error, count); what fails for a repository's address is recorded, and the scan goes on."""
        remote = hosting.is_remote(target)
        place = os.path.join(clones, str(every_target.index(target))) if remote else target
        try:
            if remote:
                clone(target, place, tokens.get(hosting.owner(target).lower(), args.token) or None)
            found = scanned(target, place)
            return target, found, "", found.count()
        except Exception as e:
            if not remote:
                raise
            return target, None, str(e)[:500], 0

    every, before, after = None, 0, 0
    try:
        for target in targets:
            jobs.setdefault(target, {"attempts": 0, "status": "pending"})
        with ThreadPoolExecutor(max(1, args.repo_concurrency)) as pool:
            waiting = []
            for target in targets:
                jobs[target].update(status="running", attempts=jobs[target].get("attempts", 0) + 1, error="")
                waiting.append(pool.submit(one, target))
            save()
            for target, result in zip(targets, waiting):
                try:
                    _, found, error, count = result.result()
                except Exception as e:
                    jobs[target].update(status="failed", error=str(e)[:500])
                    save()
                    raise
                if found is None:
                    jobs[target].update(status="failed", error=error)
                    console.say(f"{target} failed: {error}", "error")
                    save()
                    continue
                jobs[target].update(status="completed", findings=count)
                before += count
                new = scan.without(found, baseline)
                if args.verify:
                    from .operators.detect import verify

                    new = verify(new, verifiers(detectors), args.verify_store).cache()
                    held.append(new)
                after += new.count() if baseline is not None else count
                for org in discovery.get("orgs", ()):
                    org["findings"] += count if org["name"] == hosting.owner(target) else 0
                console.say(f"{target}: {count} findings")
                console.findings(new, args.raw_secrets)
                if writer:
                    writer.write(new)
                save()
                every = new if every is None else every.unionByName(new)
    finally:
        if writer:
            writer.close()
    if args.summary:
        sinks.write_private(args.summary, json.dumps(sinks.summary(jobs, discovery, before, after, every_target), indent=2) + "\n")
    if every is None:
        return 0
    if args.write_baseline:
        sinks.write_baseline(every, args.write_baseline)
    if args.write_baseline_index:
        accepted.write(every, args.write_baseline_index)
    if not writer:
        if written:
            with open(written, "wb") as f:
                f.writelines(sinks.report(every, args.format, {"targets": targets}, args.raw_secrets))
        else:
            for x in sinks.render(every, args.format, {"targets": targets}, args.raw_secrets):
                print(x)
    return 2 if args.fail_on_findings and not every.isEmpty() else 0


if __name__ == "__main__":
    sys.exit(main())
