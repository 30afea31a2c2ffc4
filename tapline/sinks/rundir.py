"""The folder of a run, its manifest, and the commands run afterwards."""

from __future__ import annotations

import json
import os
import shutil
import subprocess
from datetime import UTC, datetime
from pathlib import Path

from tapline.options import NET_ID

# Name of the manifest file and of the variable that gives its place to commands.
MANIFEST, MANIFEST_VARIABLE = "_run-artifacts.json", "TAPLINE_MANIFEST"


class RunFolder:
    """<root>/<network>/<UTC time>; an existing one is an error, results are never mixed."""

    def __init__(self, net_id: str, root: str, started: datetime | None = None):
        if not NET_ID.match(net_id):
            raise ValueError(f"net_id {net_id!r}: use letters, digits and ._- only")
        self.net_id, self.started = net_id, started or datetime.now(UTC)
        self.run_id = self.started.strftime("%Y-%m-%d-%H-%M-%S")
        self.root = Path(root or "tapline_output").absolute()
        self.path = self.root / net_id / self.run_id
        self.path.parent.mkdir(parents=True, exist_ok=True)
        self.path.mkdir()
        self.files: dict[str, str] = {}

    def place(self, name: str) -> Path:
        """A path in the folder; an absolute one stays as it is."""
        return self.path / name

    def create(self, key: str, name: str):
        path = self.place(name)
        path.parent.mkdir(parents=True, exist_ok=True)
        self.files[key] = str(path.absolute())
        return path.open("w", encoding="utf-8", newline="")

    def manifest(self, read_dir: str, files: int, main_format: str, first_time: str, first_file: str, copy_to: str = "") -> Path:
        content = {"run_id": self.run_id, "net_id": self.net_id, "run_dir": str(self.path), "output_root": str(self.root), "read_dir": read_dir if ":" in read_dir.split("/")[0] else os.path.abspath(read_dir), "run_started_at_utc": self.started.strftime("%Y-%m-%dT%H:%M:%S.%fZ"), "pcap_files_count": files, "main_output_format": main_format}
        content |= {k: v for k, v in (("first_packet_ts_utc", first_time), ("first_packet_pcap_file", first_file)) if v}
        content["files"] = dict(sorted(self.files.items()))
        path = self.place(MANIFEST)
        path.write_text(json.dumps(content, indent=2) + "\n", encoding="utf-8")
        if copy_to and (target := self.place(copy_to)) != path:
            target.parent.mkdir(parents=True, exist_ok=True)
            shutil.copyfile(path, target)
        return path

    def run_hooks(self, commands: tuple[str, ...], manifest: Path) -> None:
        """Commands run one after another in the run folder; the first that fails ends the run."""
        for k, command in enumerate(commands, 1):
            done = subprocess.run(["sh", "-c", command], cwd=self.path, env=os.environ | {MANIFEST_VARIABLE: str(manifest)}, check=False)
            if done.returncode:
                raise RuntimeError(f"post-hook {k} failed with status {done.returncode}")
