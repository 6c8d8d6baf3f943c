"""Writers: snapshots, targets of a restore, table maintenance."""
